"""Printed amounts to decimals, as layered column projections over any number of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..layers import settle
from ..money import DECIMAL_DIGITS, INTEGER_DIGITS, MONEY

# Characters and words of printed figures.
DASHES = "-\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00ad"
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
GROUP_CHARS = " '’"
NOT_APPLICABLE = ("n/a", "na", "n.a.", "n.a", "not applicable", "n/m", "nm", "n.m.", "n.m", "not meaningful", "not disclosed", "not reported")
WRITTEN_ZERO = ("nil", "none", "zero", "-0-", "0-", "-0")
CURRENCY_SYMBOLS = "$€£¥₹₩₺₽₦฿₪៛₼"
FOOTNOTE_SYMBOLS = "¹²³⁰⁴⁵⁶⁷⁸⁹⁽⁾*†‡§¶"
FULL_WIDTH = ("０１２３４５６７８９，．％（）－＄", "0123456789,.%()-$")
DOT, COMMA, UNKNOWN = "dot_decimal", "comma_decimal", "unknown"

_MARKER = rf"(?:[{FOOTNOTE_SYMBOLS}]+|\(\d{{1,2}}\))"
_FOOTNOTE_RUN = rf"(?:(?<=[0-9)])\s*{_MARKER})+\s*$"
_NUMBER = {
    DOT: r"^(?:\d{1,3}(?:,\d{3})+|\d*)(?:\.\d+)?$",
    COMMA: r"^(?:\d{1,3}(?:\.\d{3})+|\d*)(?:,\d+)?$",
}
# What the layers below look for; a text without it passes them unchanged.
_CLEAN = r"^(?:[!-~](?:[ -~]*[!-~])?)?\z"
_FIGURE = r"^[0-9.,()%+' -]*\z"
_UNIT_SHAPE = rf"[A-Z{CURRENCY_SYMBOLS}]"
PARSED_FIELDS = ("value", "sign_source", "locale_used", "unit_marker", "currency_symbol", "decimals", "markers", "codes")


def strip(c: Column) -> Column:
    return F.when(c.rlike(_CLEAN), c).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def normalise_text(c: Column) -> Column:
    """Full-width forms to ASCII, exotic spaces to plain ones, ends trimmed. NFC is assumed upstream."""
    folded = F.translate(c, FULL_WIDTH[0], FULL_WIDTH[1])
    return F.when(c.rlike(_CLEAN), c).otherwise(strip(F.translate(folded, SPACES, " " * len(SPACES))))


def footnote_run(c: Column) -> Column:
    return F.regexp_extract(c, _FOOTNOTE_RUN, 0)


def footnote_markers(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit(f"({_MARKER})"), 1)


def without_footnotes(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(c, _FOOTNOTE_RUN, ""))


def _first_in(c: Column, chars: str) -> Column:
    return (F.length(c) > 0) & F.contains(F.lit(chars), F.substring(c, 1, 1))


def _last_in(c: Column, chars: str) -> Column:
    return (F.length(c) > 0) & F.contains(F.lit(chars), F.substring(c, -1, 1))


def _peel(df: DataFrame, text: str, symbol: str) -> DataFrame:
    """Remove one leading or trailing currency symbol or code, if a number is left behind. Only a text with a symbol or a capital (`_units`) is looked at."""
    t = F.trim(F.col(text))
    iso = F.when(t.rlike("[A-Z]{3}"), F.regexp_extract(t, r"^([A-Z]{3})\b|\b([A-Z]{3})$", 0)).otherwise("")
    rest = F.trim(F.when(t.startswith(iso), F.substr(t, F.lit(4))).otherwise(F.substr(t, F.lit(1), F.length(t) - 3)))
    head, tail = _first_in(t, CURRENCY_SYMBOLS), _last_in(t, CURRENCY_SYMBOLS)
    code = (iso != "") & rest.rlike(r"\d")
    taken = F.when(head, F.substring(t, 1, 1)).when(tail, F.substring(t, -1, 1)).when(code, iso)
    left = (
        F.when(head, F.substr(t, F.lit(2)))
        .when(tail, F.substr(t, F.lit(1), F.length(t) - 1))
        .when(code, rest)
        .otherwise(t)
    )
    peeled = F.when(taken.isNull(), F.col(symbol)).otherwise(F.concat(F.coalesce(symbol, F.lit("")), taken))
    return df.withColumns({text: F.when(F.col("_units"), F.trim(left)).otherwise(t), symbol: F.when(F.col("_units"), peeled).otherwise(F.col(symbol))})


def reading(core: Column, locale: str) -> Column:
    """The digits read under one separator convention as decimal text, or NULL if it is not a number there. Its group characters are apostrophes (`one_group`)."""
    group, point = (",", ".") if locale == DOT else (".", ",")
    t = F.replace(core, F.lit("'"), F.lit(group))
    plain = F.replace(F.replace(t, F.lit(group), F.lit("")), F.lit(point), F.lit("."))
    text = F.concat(F.when(core.startswith(point), "0").otherwise(""), plain)
    return F.when((core != "") & t.rlike(_NUMBER[locale]), text)


def one_group(core: Column) -> Column:
    return F.when(core.rlike(r"^[0-9.,]*\z"), core).otherwise(F.translate(core, GROUP_CHARS, "'" * len(GROUP_CHARS)))


def parse_amounts(df: DataFrame, raw: str = "raw_value", locale: str = "locale", out: str = "parsed") -> DataFrame:
    """Adds a struct with the value, or NULL and the reason code. Nothing is guessed: a figure two
    conventions read differently stays unread until the document's locale is confirmed."""
    keep = df.columns
    d = settle(df.withColumn("_t", F.coalesce(normalise_text(F.col(raw)), F.lit(""))), keep)
    # every later text is a piece of this one, so what it lacks they lack
    figure = F.col("_t").rlike(_FIGURE)
    d = settle(d.withColumns({"_units": ~figure & F.col("_t").rlike(_UNIT_SHAPE), "_marked": F.when(figure, F.col("_t").rlike(r"\(\d{1,2}\)")).otherwise(F.col("_t").rlike(_MARKER))}), keep)
    run = lambda c: F.when(F.col("_marked"), footnote_run(c)).otherwise("")
    unmarked = lambda c: F.when(F.col("_marked"), without_footnotes(c)).otherwise(F.rtrim(c))
    d = d.withColumns({"_low": F.btrim(F.lower("_t"), F.lit(". ")), "_run": run(F.col("_t")), "_b": unmarked(F.col("_t")), "_sym": F.lit(None).cast("string")})
    d = settle(d, keep)
    for _ in range(3):
        d = settle(_peel(d, "_b", "_sym"), keep)
    pct = F.col("_b").endswith("%")
    d = d.withColumns(
        {
            "_unit": F.when(pct, "percent").when(F.col("_sym").isNotNull(), "currency").otherwise("none"),
            "_b": F.trim(F.when(pct, F.substr("_b", F.lit(1), F.length("_b") - 1)).otherwise(F.col("_b"))),
        }
    )
    d = settle(d, keep)
    paren = F.col("_b").startswith("(") & F.col("_b").endswith(")")
    d = d.withColumns({"_paren": paren, "_inner": F.when(paren, F.trim(F.substr("_b", F.lit(2), F.length("_b") - 2))).otherwise(F.col("_b"))})
    d = settle(d, keep)
    lead = (F.col("_inner") == "") | _first_in(F.col("_inner"), DASHES)
    plus = ~lead & F.col("_inner").startswith("+")
    d = d.withColumns({"_lead": lead, "_plus": plus, "_c": F.when(lead | plus, F.trim(F.substr("_inner", F.lit(2)))).otherwise(F.col("_inner"))})
    d = settle(d, keep)
    trail = (F.col("_c") == "") | _last_in(F.col("_c"), DASHES)
    d = d.withColumns({"_trail": trail, "_c": F.when(trail, F.trim(F.substr("_c", F.lit(1), F.greatest(F.length("_c") - 1, F.lit(0))))).otherwise(F.col("_c"))})
    d = settle(d, keep)
    signs = F.col("_paren").cast("int") + F.col("_lead").cast("int") + F.col("_plus").cast("int") + F.col("_trail").cast("int")
    d = d.withColumns({"_signs": signs, "_run2": run(F.col("_c")), "_c": unmarked(F.col("_c")), "_sym2": F.lit(None).cast("string")})
    d = settle(d, keep)
    for _ in range(3):
        d = settle(_peel(d, "_c", "_sym2"), keep)
    d = settle(d.withColumn("_g", one_group(F.col("_c"))), keep)
    loc = F.coalesce(F.col(locale), F.lit(UNKNOWN))
    none = F.array().cast("array<string>")
    d = d.withColumns(
        {
            "_own": F.when(loc == COMMA, reading(F.col("_g"), COMMA)).otherwise(reading(F.col("_g"), DOT)),
            "_sym": F.coalesce("_sym", "_sym2"),
            "_marks": F.when(F.col("_marked"), F.concat(footnote_markers(F.col("_run")), footnote_markers(F.col("_run2")))).otherwise(none),
        }
    )
    d = settle(d, keep)
    # a figure that reads under the document's own convention is not read under the other
    d = d.withColumns(
        {
            "_dot": F.when(loc != COMMA, F.col("_own")).when(F.col("_own").isNull(), reading(F.col("_g"), DOT)),
            "_comma": F.when(loc == COMMA, F.col("_own")).when((loc != DOT) | F.col("_own").isNull(), reading(F.col("_g"), COMMA)),
        }
    )
    d = settle(d, keep)
    both_differ = F.col("_dot").isNotNull() & F.col("_comma").isNotNull() & (F.col("_dot") != F.col("_comma"))
    chosen = (
        F.when(loc == DOT, F.col("_dot")).when(loc == COMMA, F.col("_comma")).when(~both_differ, F.coalesce("_dot", "_comma"))
    )
    na = F.col("_low").isin(*NOT_APPLICABLE) | F.btrim(F.lower("_inner"), F.lit(". ")).isin(*NOT_APPLICABLE)
    code = (
        F.when(F.col("_t") == "", "BLANK_CELL")
        .when(F.col("_low").isin(*WRITTEN_ZERO), "WRITTEN_ZERO")
        .when(F.col("_lead") & (F.col("_inner") != "") & F.col("_inner").rlike(f"^[ {DASHES[1:]}-]+$"), "DASH_AMBIGUOUS")
        .when(na, "NOT_APPLICABLE")
        .when(F.col("_signs") > 1, "SIGN_UNRESOLVED")
        .when(F.col("_c") == "", "NOT_NUMERIC")
        .when(F.col("_dot").isNull() & F.col("_comma").isNull(), "NOT_NUMERIC")
        .when(chosen.isNull(), "SEPARATOR_AMBIGUOUS")
        .when((F.length(chosen) > INTEGER_DIGITS) & (F.length(F.regexp_replace(F.regexp_extract(chosen, r"^(\d*)", 1), "^0+", "")) > INTEGER_DIGITS), "OUT_OF_RANGE")
        .when((F.length(F.substring_index(chosen, ".", -1)) > DECIMAL_DIGITS) & (F.length(F.regexp_replace(F.regexp_extract(chosen, r"\.(\d+)$", 1), "0+$", "")) > DECIMAL_DIGITS), "TOO_PRECISE")
    )
    d = settle(d.withColumns({"_code": code, "_num": chosen}), keep)
    negative = F.col("_paren") | F.col("_lead") | F.col("_trail")
    value = F.when(F.col("_code").isNull(), F.concat(F.when(negative, "-").otherwise(""), "_num").try_cast(MONEY)).when(F.col("_code") == "WRITTEN_ZERO", F.lit(0).cast(MONEY))
    source = (
        F.when(F.col("_code") == "WRITTEN_ZERO", "positive_as_printed")
        .when(F.col("_code") == "SIGN_UNRESOLVED", "unresolved")
        .when(F.col("_code").isNotNull(), "not_applicable")
        .when(F.col("_lead"), "leading_minus")
        .when(F.col("_plus"), "leading_plus")
        .when(F.col("_paren"), "parentheses")
        .when(F.col("_trail"), "trailing_minus")
        .otherwise("positive_as_printed")
    )
    used = F.when(F.col("_code").isNotNull() & (F.col("_code") != "WRITTEN_ZERO"), UNKNOWN).when(loc != UNKNOWN, loc).when(F.col("_dot").isNull(), COMMA).when(F.col("_comma").isNull(), DOT).otherwise(UNKNOWN)
    used = F.when(F.col("_code") == "WRITTEN_ZERO", loc).otherwise(used)
    numeric_stage = F.col("_code").isNull() | F.col("_code").isin("SEPARATOR_AMBIGUOUS") | ((F.col("_code") == "NOT_NUMERIC") & (F.col("_c") != ""))
    codes = F.array_compact(F.array(F.when(numeric_stage & (F.size("_marks") > 0), "FOOTNOTE_MARKER_STRIPPED"), F.col("_code")))
    shown = ~F.coalesce(F.col("_code").isin("BLANK_CELL", "WRITTEN_ZERO"), F.lit(False))
    parsed = F.struct(
        value.alias("value"),
        source.alias("sign_source"),
        used.alias("locale_used"),
        F.when(shown & (F.col("_unit") == "none") & F.col("_sym").isNotNull(), "currency").when(shown, F.col("_unit")).otherwise("none").alias("unit_marker"),
        F.when(shown, F.col("_sym")).alias("currency_symbol"),
        F.when(F.col("_code").isNull(), F.length(F.regexp_extract("_num", r"\.(\d+)$", 1))).when(F.col("_code") == "WRITTEN_ZERO", 0).alias("decimals"),
        F.when(shown, F.col("_marks")).otherwise(F.array().cast("array<string>")).alias("markers"),
        codes.alias("codes"),
    )
    return settle(d.select(*keep, parsed.alias(out)), keep)
