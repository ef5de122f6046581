from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspan.functions import amounts as A
from ledgerspan.functions import labels as LB

US, EU, UNK = "dot_decimal", "comma_decimal", "unknown"
CASES = [
    ("", US, None, "BLANK_CELL"), ("   ", US, None, "BLANK_CELL"), (None, US, None, "BLANK_CELL"),
    *[(d, US, None, "DASH_AMBIGUOUS") for d in ("-", "–", "—", "−", "$—", "(—)")],
    *[(d, US, None, "NOT_APPLICABLE") for d in ("N/A", "n/a", "Not applicable", "n/m")],
    *[(d, US, "0", "WRITTEN_ZERO") for d in ("nil", "none", "NIL", "-0-", "zero")],
    ("1,234", US, "1234", None), ("1,234", EU, "1.234", None), ("1,234", UNK, None, "SEPARATOR_AMBIGUOUS"),
    ("1,234.56", US, "1234.56", None), ("1.234,56", EU, "1234.56", None), ("1 234,56", EU, "1234.56", None), ("1'234.56", US, "1234.56", None),
    ("1,234,567", UNK, "1234567", None), ("1.234.567", UNK, "1234567", None), ("1,23", UNK, "1.23", None), ("12", UNK, "12", None), (".5", UNK, "0.5", None),
    ("1.234,56", US, None, "SEPARATOR_AMBIGUOUS"),
    ("abc", US, None, "NOT_NUMERIC"), ("1..2", US, None, "NOT_NUMERIC"), ("12/31/2025", US, None, "NOT_NUMERIC"), ("1,23,456", US, None, "NOT_NUMERIC"), ("1,234.", US, None, "NOT_NUMERIC"),
    ("(1,234)", US, "-1234", None), ("-1,234", US, "-1234", None), ("−1,234", US, "-1234", None), ("1,234-", US, "-1234", None), ("+1,234", US, "1234", None),
    ("1,234¹", US, "1234", None), ("1,234(2)", US, "1234", None), ("(12,000)¹", US, "-12000", None), ("(1,234)(2)", US, "-1234", None), ("1,234*", US, "1234", None),
    ("(1)", US, "-1", None), ("$1,234", US, "1234", None), ("1,234 USD", US, "1234", None), ("USD 1,234", US, "1234", None), ("€1.234", EU, "1234", None),
    ("(-5)", US, None, "SIGN_UNRESOLVED"), ("12.5%", US, "12.5", None), ("１，２３４", US, "1234", None), ("ABC", US, None, "NOT_NUMERIC"),
    ("$", US, None, "SIGN_UNRESOLVED"), ("$ (1,234)", US, "-1234", None), ("1,234 (2) (3)", US, "1234", None),
]


def test_amount_table(spark):
    df = spark.createDataFrame([(i, r, loc) for i, (r, loc, _, _) in enumerate(CASES)], "i int, raw_value string, locale string")
    rows = {r.i: r.parsed for r in A.parse_amounts(df).collect()}
    for i, (raw, loc, value, code) in enumerate(CASES):
        p = rows[i]
        want = None if value is None else Decimal(value)
        assert p.value == want, (raw, loc, p)
        own = [c for c in p.codes if c != "FOOTNOTE_MARKER_STRIPPED"]
        assert own == ([code] if code else []), (raw, loc, p)


def test_sign_sources_and_markers(spark):
    raws = ["(1,234)", "-1,234", "1,234-", "+1,234", "1,234(2)", "USD 1,234", "12%"]
    df = spark.createDataFrame([(r, US) for r in raws], "raw_value string, locale string")
    got = {r.raw_value: r.parsed for r in A.parse_amounts(df).collect()}
    assert got["(1,234)"].sign_source == "parentheses"
    assert got["-1,234"].sign_source == "leading_minus"
    assert got["1,234-"].sign_source == "trailing_minus"
    assert got["+1,234"].sign_source == "leading_plus"
    assert got["1,234(2)"].markers == ["(2)"] and "FOOTNOTE_MARKER_STRIPPED" in got["1,234(2)"].codes
    assert got["USD 1,234"].currency_symbol == "USD" and got["USD 1,234"].unit_marker == "currency"
    assert got["12%"].unit_marker == "percent"


@pytest.mark.parametrize(
    "text,label,ambiguous",
    [
        ("2024", "2024", False), ("FY2025", "2025", False), ("2025A", "2025", False), ("December 31, 2024", "2024", False), ("Revenue", None, False),
        ("2025 2024", "2025 2024", True), ("For the years ended December 31, 2025 and 2024", "For the years ended December 31, 2025 and 2024", True),
        ("2024 (restated)", "2024 (restated)", True), ("2024*", "2024*", True), ("FY2024 (pro forma)", "FY2024 (pro forma)", True), ("", None, False), ("Q3 2024", "Q3 2024", True),
    ],
)
def test_period_labels(spark, text, label, ambiguous):
    p = spark.createDataFrame([(text,)], "t string").select(LB.period_label(F.col("t")).alias("p")).first().p
    assert (p.label, p.ambiguous) == (label, ambiguous)


def test_proposals(spark):
    rows = [("Net sales", "income", "revenue"), ("Cost of goods sold", "income", "cogs"), ("Total current assets", "balance", None),
            ("Goodwill", "balance", "goodwill"), ("Depreciation and amortization", "cashflow", "depreciation_amortization"), ("Cash", "income", None), ("Net income", "cashflow", "net_income")]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "label string, statement string")
    got = {(r.label, r.statement): r.c for r in df.select("label", "statement", LB.candidates(F.col("label"), F.col("statement")).alias("c")).collect()}
    for label, st, want in rows:
        c = got[(label, st)]
        assert (c[0].account if c else None) == want, (label, c)
    assert len(LB.RULES) == 88


def test_figures_beyond_the_type_are_coded_and_reviewed(spark):
    from ledgerspan import dims

    rows = [("123456789012345678", "OUT_OF_RANGE"), ("0.123456789", "TOO_PRECISE"), ("-0.000000001", "TOO_PRECISE"), ("12345678901234567.5", None), ("0.12345678", None), ("1.5000000000", None), ("000000000000000000012", None)]
    df = spark.createDataFrame([(r, "dot_decimal") for r, _ in rows], "raw_value string, locale string")
    got = {r.raw_value: r.parsed for r in A.parse_amounts(df).collect()}
    for raw, code in rows:
        assert (code in got[raw].codes if code else got[raw].codes == []) and (got[raw].value is None) == bool(code), raw
        assert code is None or code in dims.BLOCKING


def test_label_rules_run_once_per_distinct_label(spark):
    from ledgerspan.operators import mapping as MP

    labels = [("Net sales", "income"), ("net  sales", "income"), ("Goodwill", "balance"), ("Goodwill", None), (None, "income"), ("Total current assets", "balance")]
    facts = spark.createDataFrame([(i, *labels[i % len(labels)]) for i in range(120)], "fact_id int, raw_label string, statement string")
    got = MP.propose(facts)
    assert "Aggregate [_label" in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.fact_id: [(c.account, c.score) for c in r.candidates] for r in got.collect()}
    assert len(rows) == 120 and rows[0] == rows[1] == rows[7] and rows[0][0] == ("revenue", 95)
    assert rows[2][0] == rows[3][0] == ("goodwill", 95) and rows[4] == rows[5] == []


def test_layers_that_a_text_passes_unchanged_are_not_skipped_wrongly(spark):
    """A line end before the end of the text, a figure under the other convention, marks and codes beside digits."""
    raws = [("12\n", US, "12"), ("\t(1,234) ", US, "-1234"), ("1.234,5", UNK, "1234.5"), ("1'234,5", EU, "1234.5"), ("$(2)", US, "-2"), ("(1,234)(12)", US, "-1234"), ("EUR 5", EU, "5"), ("5 eur", EU, None), (",5", EU, "0.5")]
    df = spark.createDataFrame([(i, r, loc) for i, (r, loc, _) in enumerate(raws)], "i int, raw_value string, locale string")
    got = {r.i: r.parsed.value for r in A.parse_amounts(df).collect()}
    assert got == {i: None if v is None else Decimal(v) for i, (_, _, v) in enumerate(raws)}
