"""Registered queries over the derived ledger: derivation, checks, growth, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import ledger as L
from ..sources import derived as D
from .duck import cte, q, sql, unpivot, values, _PREFIX
from .registry import as_double, dbl, register, sd

KEY = "company_id, year"
SLOT = [(s, a, _PREFIX[s] + a) for s, a in dims.slots()]


def wide(spark, sf):
    return L.to_wide(D.ledger(spark, sf))


def full(spark, sf):
    return L.fill_derivable(wide(spark, sf))


# Long form of wide columns with a second column beside each.
def pairs(src: str, second) -> str:
    return " UNION ALL ".join(
        f"SELECT {KEY}, n, '{s}' AS statement, '{a}' AS account, {c} AS value, {second(s, a, c)} AS other FROM {src}"
        for s, a, c in SLOT
    )


cte("numbered", "SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year) AS n FROM derived", "derived")
cte(
    "growthrows",
    "SELECT company_id, year, n, statement, account, value, lag(value) OVER (PARTITION BY company_id, statement, account ORDER BY year) AS prior FROM ("
    + pairs("numbered", lambda s, a, c: "NULL") + ")",
    "numbered",
)
_BASE = {"income": "is_revenue", "cashflow": "is_revenue", "balance": "bs_total_assets"}
cte("sizerows", pairs("numbered", lambda s, a, c: _BASE[s]), "numbered")

GROWTH_SQL = sql(
    "SELECT company_id, year, statement, account, " + sd("value", "value")
    + ", CAST(round_even(CAST(CASE WHEN prior <> 0 THEN (value - prior) / abs(prior) * 100 END AS DECIMAL(20,8)), 1) AS DOUBLE) AS growth_pct,"
    " CASE WHEN n = 1 THEN 'first period' WHEN prior IS NULL THEN 'prior period not reported' WHEN prior = 0 THEN 'prior period is zero' END AS reason"
    " FROM growthrows WHERE value IS NOT NULL",
    "growthrows",
)


@register("w01_growth", GROWTH_SQL)
def w01(spark, sf):
    g = L.growth(full(spark, sf))
    return g.select("company_id", "year", "statement", "account", dbl("value").alias("value"), F.col("growth_pct").cast("double").alias("growth_pct"), "reason")


SIZE_SQL = (
    "CAST(round_even(CAST(CASE WHEN {b} <> 0 THEN {v} / {b} * 100 END AS DECIMAL(20,8)), 1) AS DOUBLE)"
)


@register(
    "w02_common_size",
    sql(
        "SELECT company_id, year, statement, account, " + SIZE_SQL.format(v="value", b="other") + " AS common_size_pct,"
        " CASE WHEN other IS NULL THEN 'base not reported' WHEN other = 0 THEN 'base is zero' END AS reason"
        " FROM sizerows WHERE value IS NOT NULL",
        "sizerows",
    ),
)
def w02(spark, sf):
    c = L.common_size(full(spark, sf))
    return c.select("company_id", "year", "statement", "account", F.col("common_size_pct").cast("double").alias("common_size_pct"), "reason")


FLAGSHIP_SQL = sql(
    "SELECT g.company_id, g.year, g.statement, g.account, " + sd("g.value", "value")
    + ", CAST(round_even(CAST(CASE WHEN g.prior <> 0 THEN (g.value - g.prior) / abs(g.prior) * 100 END AS DECIMAL(20,8)), 1) AS DOUBLE) AS growth_pct, "
    + SIZE_SQL.format(v="g.value", b="s.other") + " AS common_size_pct"
    " FROM growthrows g JOIN sizerows s USING (company_id, year, statement, account) WHERE g.value IS NOT NULL",
    "growthrows", "sizerows",
)


@register("statement_analysis", FLAGSHIP_SQL)
def statement_analysis(spark, sf):
    """Every line of every company with growth and common size, in one shuffle after the ledger."""
    f = L.with_prior(full(spark, sf), L.slot_columns())
    rows = [(f"'{s}'", f"'{a}'", c, f"prev_{c}", _BASE[s]) for s, a, c in SLOT]
    v, p, b = F.col("value"), F.col("prior"), F.col("base")
    return (
        f.selectExpr("company_id", "year", L.stacked(rows, ("statement", "account", "value", "prior", "base")))
        .where(v.isNotNull())
        .select(
            "company_id", "year", "statement", "account", dbl("value").alias("value"),
            F.bround((F.try_divide(v - p, F.abs(p)) * 100).cast("decimal(20,8)"), 1).cast("double").alias("growth_pct"),
            F.bround((F.try_divide(v, b) * 100).cast("decimal(20,8)"), 1).cast("double").alias("common_size_pct"),
        )
    )


def _drv(t: str) -> str:
    s, plus, minus = dims.DERIVATIONS[t]
    px, here = _PREFIX[s], set(dims.accounts_of(s))
    terms = [(x, "+") for x in plus] + [(x, "-") for x in minus]
    if any(x not in here and x not in dims.OPTIONAL_TERMS for x, _ in terms):
        return "CAST(NULL AS DECIMAL(25,8))"
    cond = [f"{px}{x} IS NOT NULL" for x, _ in terms if x not in dims.OPTIONAL_TERMS]
    cond.append("(" + " OR ".join(f"{px}{x} IS NOT NULL" for x, _ in terms) + ")")
    return f"CASE WHEN {' AND '.join(cond)} THEN CAST(0 " + " ".join(f"{o} COALESCE({px}{x}, 0)" for x, o in terms) + " AS DECIMAL(25,8)) END"


def _drv_rows(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {KEY}, '{s}' AS statement, '{t}' AS account, {_PREFIX[s]}{t} AS reported, {_drv(t)} AS derived FROM {src}"
        for t, (s, _, _) in dims.DERIVATIONS.items()
    )


cte("drv", _drv_rows("wide"), "wide")
CLOSE = "abs({a} - {b}) <= greatest(greatest(abs({a}), abs({b})) * CAST({rel} AS DECIMAL(10,9)), CAST({floor} AS DECIMAL(10,9)))"


def close_sql(a: str, b: str, rel: str = "'0.000000001'", floor: str = "'0'") -> str:
    return CLOSE.format(a=a, b=b, rel=rel, floor=floor)


@register(
    "j07_derive_terms",
    sql("SELECT company_id, year, statement, account, " + sd("derived", "derived") + " FROM drv WHERE derived IS NOT NULL", "drv"),
)
def j07(spark, sf):
    d = L.derive_terms(wide(spark, sf))
    rows = [(f"'{s}'", f"'{t}'", f"drv_{t}") for t, (s, _, _) in dims.DERIVATIONS.items()]
    return as_double(d.selectExpr("company_id", "year", L.stacked(rows, ("statement", "account", "derived"))).where("derived IS NOT NULL"), "derived")


@register(
    "j08_derive_fixpoint",
    sql(
        "SELECT f.company_id, f.year, f.statement, f.account, " + sd("f.value", "value")
        + ", CASE WHEN l.value IS NULL THEN 'derived' ELSE 'reported' END AS origin FROM filled f LEFT JOIN ledger l USING (company_id, year, statement, account)",
        "filled",
    ),
)
def j08(spark, sf):
    f = L.filled_ledger(D.ledger(spark, sf))
    return as_double(f.select("company_id", "year", "statement", "account", "value", "origin"), "value")


@register(
    "j09_cross_check",
    sql(
        "SELECT company_id, year, statement, account, " + sd("reported", "reported") + ", " + sd("derived", "derived") + ", " + sd("reported - derived", "difference")
        + " FROM drv WHERE reported IS NOT NULL AND derived IS NOT NULL AND NOT (" + close_sql("reported", "derived", "'0.000001'") + ")",
        "drv",
    ),
)
def j09(spark, sf):
    d = L.discrepancies(wide(spark, sf)).drop("relative_error_pct")
    return as_double(d, "reported", "derived", "difference")


def _missing(t: str) -> str:
    s, plus, minus = dims.DERIVATIONS[t]
    px, here = _PREFIX[s], set(dims.accounts_of(s))
    req = [x for x in plus + minus if x not in dims.OPTIONAL_TERMS]
    if not req:
        return "''"
    return "concat_ws(', ', " + ", ".join(f"'{x}'" if x not in here else f"CASE WHEN {px}{x} IS NULL THEN '{x}' END" for x in req) + ")"


@register(
    "j36_computed_vs_reported",
    sql(
        " UNION ALL ".join(
            f"SELECT {KEY}, '{t}' AS account, {sd(_PREFIX[s] + t, 'reported')}, {sd(_drv(t), 'computed')}, {_missing(t)} AS missing,"
            f" {close_sql(_PREFIX[s] + t, _drv(t), chr(39) + '0.000001' + chr(39))} AS agrees FROM wide"
            for t, (s, _, _) in dims.DERIVATIONS.items()
        ),
        "wide",
    ),
)
def j36(spark, sf):
    d = L.computed_vs_reported(wide(spark, sf))
    return as_double(d.select("company_id", "year", "account", "reported", "computed", F.array_join("missing", ", ").alias("missing"), "agrees"), "reported", "computed")


@register(
    "a18_comparable_count",
    sql("SELECT company_id, CAST(count(*) FILTER (WHERE reported IS NOT NULL AND derived IS NOT NULL) AS BIGINT) AS comparable FROM drv GROUP BY company_id", "drv"),
)
def a18(spark, sf):
    return L.comparable_count(wide(spark, sf))


@register("p01_validate_account", sql(
    "SELECT o_orderkey AS row_id, account FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'revenue' WHEN '2-HIGH' THEN 'cash' WHEN '3-MEDIUM' THEN 'capex' ELSE lower(o_orderpriority) END AS account FROM orders)"
    " WHERE account NOT IN (" + ", ".join(q(a) for a in dims.accounts_of("income")) + ")"))
def p01(spark, sf):
    o = F.col("o_orderpriority")
    rows = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.lit("income").alias("statement"),
        F.when(o == "1-URGENT", "revenue").when(o == "2-HIGH", "cash").when(o == "3-MEDIUM", "capex").otherwise(F.lower(o)).alias("account"),
    )
    return L.validate_accounts(rows).select("row_id", "account")


@register("j10_net_income_linkage", sql(
    "SELECT company_id, year, " + sd("is_net_income", "on_income") + ", " + sd("cf_net_income", "on_cashflow") + ", "
    + close_sql("is_net_income", "cf_net_income") + " AS agrees FROM derived WHERE is_net_income IS NOT NULL AND cf_net_income IS NOT NULL", "derived"))
def j10(spark, sf):
    return as_double(L.net_income_linkage(full(spark, sf)), "on_income", "on_cashflow")


@register("j11_prior_period", sql(
    "SELECT company_id, year, lag(year) OVER (PARTITION BY company_id ORDER BY year) AS prior FROM (SELECT DISTINCT company_id, year FROM ledger)", "ledger"))
def j11(spark, sf):
    return L.shared_years(D.ledger(spark, sf)).withColumn("prior", F.lag("year").over(L.by_year()))


@register("j12_cash_continuity", sql(
    "SELECT b.company_id, b.year, " + sd("a.bs_cash", "opening") + ", " + sd("b.bs_cash", "closing") + ", "
    + sd("a.bs_cash + b.cf_cash_flow_from_operations + b.cf_cash_flow_from_investing + b.cf_cash_flow_from_financing", "expected") + ", "
    + close_sql("(a.bs_cash + b.cf_cash_flow_from_operations + b.cf_cash_flow_from_investing + b.cf_cash_flow_from_financing)", "b.bs_cash") + " AS agrees"
    " FROM derived a JOIN derived b ON a.company_id = b.company_id AND b.year = a.year + 1"
    " WHERE a.bs_cash IS NOT NULL AND b.bs_cash IS NOT NULL AND b.cf_cash_flow_from_operations + b.cf_cash_flow_from_investing + b.cf_cash_flow_from_financing IS NOT NULL", "derived"))
def j12(spark, sf):
    from ..operators import checks as C

    d = C.cash_rollforward_rows(full(spark, sf))
    return as_double(d.select("company_id", "year", "opening", "closing", "expected", "agrees"), "opening", "closing", "expected")


@register("t03_statement_order", sql(
    "SELECT f.company_id, f.year, f.statement, f.account, c.display_name, CAST(c.display_order AS INTEGER) AS display_order, " + sd("f.value", "value")
    + " FROM filled f JOIN (" + values([(a, s, n, i) for i, (a, ss, _, _, _, n) in enumerate(dims.CHART) for s in ss], "account, statement, display_name, display_order", "c") + ") c"
    " USING (statement, account)", "filled"))
def t03(spark, sf):
    f = L.to_long(full(spark, sf))
    r = L.statement_rows(f).orderBy("company_id", "statement", "year", "display_order")
    return as_double(r.select("company_id", "year", "statement", "account", "display_name", "display_order", "value"), "value")


@register("a03_section_total", sql(
    "SELECT company_id, year, section, " + sd("SUM(value)", "total") + " FROM ledger JOIN ("
    + values([("assets", a) for a in dims.ASSETS] + [("liabilities", a) for a in dims.LIABILITIES] + [("equity", a) for a in dims.EQUITY], "section, account", "s")
    + ") s USING (account) GROUP BY company_id, year, section", "ledger"))
def a03(spark, sf):
    return as_double(L.section_total(D.ledger(spark, sf), {"assets": dims.ASSETS, "liabilities": dims.LIABILITIES, "equity": dims.EQUITY}), "total")


@register("a21_series_summary", sql(
    "SELECT company_id, " + sd("arg_min(value, year)", "first_value") + ", " + sd("arg_max(value, year)", "last_value")
    + ", min(year) AS first_year, max(year) AS last_year, CAST(round_even(CAST((arg_max(value, year) - arg_min(value, year)) / nullif(abs(arg_min(value, year)), 0) * 100 AS DECIMAL(20,8)), 1) AS DOUBLE) AS change_pct"
    " FROM ledger WHERE account = 'revenue' GROUP BY company_id", "ledger"))
def a21(spark, sf):
    s = L.series_summary(D.ledger(spark, sf), "revenue", "income")
    return as_double(s, "first_value", "last_value").withColumn("change_pct", F.col("change_pct").cast("double"))


@register("l01_ledger_get", sql(
    "SELECT w.company_id, w.year, w.account FROM (SELECT DISTINCT company_id, year, a.account FROM ledger, ("
    + values([("taxes",), ("accounts_payable",), ("change_in_nwc",), ("revenue",)], "account", "a") + ") a) w"
    " WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.company_id = w.company_id AND l.year = w.year AND l.account = w.account)", "ledger"))
def l01(spark, sf):
    led = D.ledger(spark, sf)
    need = [("income", "taxes"), ("balance", "accounts_payable"), ("cashflow", "change_in_nwc"), ("income", "revenue")]
    wanted = L.shared_years(led).select("company_id", "year", F.inline(F.array(*[F.struct(F.lit(s).alias("statement"), F.lit(a).alias("account")) for s, a in need])))
    return L.require(led, wanted).select("company_id", "year", "account")


@register("l13_chart_for_statement", sql(
    "SELECT account, expected_sign, CAST(count(*) AS BIGINT) AS cells, " + sd("sum(value)", "total") + " FROM ledger JOIN ("
    + values([(a, sg) for a, ss, sg, *_ in dims.CHART if "cashflow" in ss], "account, expected_sign", "c") + ") c USING (account)"
    " WHERE statement = 'cashflow' GROUP BY account, expected_sign", "ledger"))
def l13(spark, sf):
    c = L.chart_for_statement(D.ledger(spark, sf), "cashflow")
    return as_double(c.groupBy("account", "expected_sign").agg(F.count("*").alias("cells"), F.sum("value").alias("total")), "total")


@register("l01_accounts_present", sql(
    "SELECT company_id, statement, year, array_to_string(list_sort(list(DISTINCT account)), ',') AS accounts FROM ledger GROUP BY company_id, statement, year", "ledger"))
def l01b(spark, sf):
    return L.accounts_present(D.ledger(spark, sf)).withColumn("accounts", F.array_join("accounts", ","))


@register("u06_shared_years", sql("SELECT DISTINCT company_id, year FROM ledger", "ledger"))
def u06(spark, sf):
    return L.shared_years(D.ledger(spark, sf))


@register("j40_ledger_axis_extend", sql(
    "SELECT company_id, statement, account, year, " + sd("value", "value") + " FROM ledger WHERE year IN (SELECT DISTINCT year(o_orderdate) FROM orders)", "ledger"))
def j40(spark, sf):
    axis = D.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    e = L.extend_axis(D.ledger(spark, sf), axis)
    return as_double(e.select("company_id", "statement", "account", "year", "value"), "value")


@register("j30_forecast_hardcodes", sql(
    "SELECT company_id, statement, account, year FROM ledger WHERE year >= 2001", "ledger"))
def j30(spark, sf):
    return L.hardcodes(D.ledger(spark, sf), 2001).select("company_id", "statement", "account", "year")
