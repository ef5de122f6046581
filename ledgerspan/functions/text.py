"""Rules over whole document texts: redaction, secret shapes, metadata, number locale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Redaction patterns and what replaces them, in order.
REDACTIONS = (
    (r"scrypt\$[0-9]+\$[0-9]+\$[0-9]+\$[^\s]+", "[redacted: credential]"),
    (r"\b[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{40,}\b", "[redacted: token]"),
    (r"(?i)\b(password|secret|token|api[_-]?key|authorization)\b\s*[:=]\s*(?:(?:bearer|basic|token|digest)\s+)?\S+", r"$1=[redacted]"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[redacted: email]"),
    (r"\b\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?\b", "[redacted: figure]"),
)

# Secret shapes.
SECRETS = (
    ("password hash", r"scrypt\$\d+\$\d+\$\d+\$[A-Za-z0-9+/=]+\$[A-Za-z0-9+/=]{20,}"),
    ("api or private key", r"(?i)\b(?:aws|api|secret|private)[_-]?key\b\s*[:=]\s*['\"]?[A-Za-z0-9/+=_-]{16,}"),
    ("private key block", r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----"),
    ("literal password", r"(?i)\bpassword\b\s*[:=]\s*['\"][^'\"\s]{8,}['\"]"),
)

# Metadata patterns, first match wins.
SCALE = r"(?i)\b(?:in|amounts?\s+in|expressed\s+in|\$\s*in)\s+(thousands?|millions?|billions?|tausend|milliarden|millionen|miles|millones)\b"
SCALE_WORDS = (
    ("thousand", "thousands"), ("thousands", "thousands"), ("tausend", "thousands"), ("miles", "thousands"), ("million", "millions"), ("millions", "millions"),
    ("millionen", "millions"), ("millones", "millions"), ("billion", "billions"), ("billions", "billions"), ("milliarden", "billions"),
)
CURRENCIES = (
    ("USD", r"(?i)\b(?:u\.?s\.?|united\s+states)\s+dollars?\b"), ("CAD", r"(?i)\bcanadian\s+dollars?\b"), ("AUD", r"(?i)\baustralian\s+dollars?\b"),
    ("EUR", r"(?i)\beuros?\b|\beuro\b"), ("GBP", r"(?i)\bpounds?\s+sterling\b|\bpounds?\b"), ("JPY", r"(?i)\byen\b"), ("CHF", r"(?i)\bswiss\s+francs?\b"),
    ("USD", r"\bUSD\b"), ("EUR", r"\bEUR\b"), ("GBP", r"\bGBP\b"), ("JPY", r"\bJPY\b"),
)
AUDITED = r"(?i)report\s+of\s+independent\s+registered\s+public\s+accounting\s+firm|independent\s+auditor'?s?\s+report|have\s+been\s+audited"
UNAUDITED = r"(?i)\bunaudited\b"
STANDARDS = (("US_GAAP", r"(?i)\bu\.?s\.?\s*gaap\b|generally\s+accepted\s+accounting\s+principles"), ("IFRS", r"(?i)\bifrs\b|international\s+financial\s+reporting\s+standards"))
FILING_TYPES = (("annual", r"(?i)form\s+10-?k\b|\bannual\s+report\b|\bjahresabschluss\b"), ("quarterly", r"(?i)form\s+10-?q\b|\bquarterly\s+report\b|\binterim\s+report\b"))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
PERIOD_END = rf"(?i)(?:fiscal\s+|financial\s+)?year\s+ended\s+(?:({_MONTH})\s+(\d{{1,2}}),?\s*(\d{{4}})|(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}}))"
ONLY_DOT = r"\b\d{1,3}(?:,\d{3})+\.\d+\b|\b\d{1,3}(?:,\d{3}){2,}\b"
ONLY_COMMA = r"\b\d{1,3}(?:\.\d{3})+,\d+\b|\b\d{1,3}(?:\.\d{3}){2,}\b"


def redact(c: Column) -> Column:
    """Every pattern applied in order to the whole text; (?U) makes \\w and \\b cover all letters."""
    for pattern, replacement in REDACTIONS:
        c = F.regexp_replace(c, "(?U)" + pattern, replacement)
    return c


def secret_shape(c: Column) -> Column:
    out = None
    for name, pattern in SECRETS:
        cond = c.rlike("(?U)" + pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def _first(c: Column, rules) -> Column:
    out = None
    for name, pattern in rules:
        cond = c.rlike("(?U)" + pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def period_end(c: Column) -> Column:
    g = [F.regexp_extract(c, PERIOD_END, i) for i in range(1, 7)]
    month_text = F.lower(F.when(g[0] != "", g[0]).otherwise(g[4]))
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(month_text, 1, 3))
    day, year = F.when(g[0] != "", g[1]).otherwise(g[3]), F.when(g[0] != "", g[2]).otherwise(g[5])
    return F.concat_ws("-", F.nullif(year, F.lit("")), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.nullif(day, F.lit("")), 2, "0")).try_cast("date")


def page_metadata(pages: DataFrame) -> DataFrame:
    """Detected value of each field on each page. pages: document_id, page, text."""
    t = F.col("text")
    scale = F.lower(F.regexp_extract(t, "(?U)" + SCALE, 1))
    words = F.create_map(*[F.lit(x) for kv in SCALE_WORDS for x in kv])
    return pages.select(
        "document_id", "page",
        F.when(scale != "", F.try_element_at(words, scale)).alias("displayed_scale"),
        _first(t, CURRENCIES).alias("reporting_currency"),
        period_end(t).alias("reporting_period_end"),
        F.when(t.rlike(AUDITED), F.lit(1)).alias("audited_hit"), F.when(t.rlike("(?U)" + UNAUDITED), F.lit(1)).alias("unaudited_hit"),
        *[F.when(t.rlike("(?U)" + p), n).alias(f"std_{n}") for n, p in STANDARDS],
        *[F.when(t.rlike("(?U)" + p), n).alias(f"type_{n}") for n, p in FILING_TYPES],
        F.size(F.regexp_extract_all(t, F.lit("(?U)(" + ONLY_DOT + ")"), 1)).alias("dot_numbers"),
        F.size(F.regexp_extract_all(t, F.lit("(?U)(" + ONLY_COMMA + ")"), 1)).alias("comma_numbers"),
    )


def detect_metadata(pages: DataFrame, cover_pages: int = 4) -> DataFrame:
    """First page's value per field over the cover, and the number locale over the whole document.

    A pattern of higher rank anywhere on the cover beats a lower one, except within a page's currency list."""
    m = page_metadata(pages)
    cover = F.col("page") <= cover_pages

    def first(c):
        return F.min_by(F.when(cover, F.col(c)), F.when(cover & F.col(c).isNotNull(), F.col("page")))

    fields = ("displayed_scale", "reporting_currency", "reporting_period_end")
    g = m.groupBy("document_id").agg(
        *[first(c).alias(c) for c in fields],
        F.when(F.max(F.when(cover, F.col("audited_hit"))) == 1, "audited").when(F.max(F.when(cover, F.col("unaudited_hit"))) == 1, "unaudited").alias("audited_status"),
        F.coalesce(*[F.max(F.when(cover, F.col(f"std_{n}"))) for n, _ in STANDARDS]).alias("accounting_standard"),
        F.coalesce(*[F.max(F.when(cover, F.col(f"type_{n}"))) for n, _ in FILING_TYPES]).alias("filing_type"),
        F.sum("dot_numbers").alias("dot_numbers"), F.sum("comma_numbers").alias("comma_numbers"),
    )
    end = F.col("reporting_period_end")
    return g.withColumns(
        {
            "reporting_period_start": F.date_add(F.add_months(end, -12), 1),
            "fiscal_year_end": F.date_format(end, "MM-dd"),
            "number_locale": F.when((F.col("dot_numbers") > 0) & (F.col("comma_numbers") == 0), "dot_decimal").when((F.col("comma_numbers") > 0) & (F.col("dot_numbers") == 0), "comma_decimal"),
        }
    )
