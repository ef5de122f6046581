"""Ledger operators: long/wide shapes, derived subtotals, cross-checks, lookups.

A ledger row is (company_id, statement, account, year, value[, origin]); an absent figure is no
row. Wide shape has one row per company and year and one nullable column per statement slot, so
derivation, growth and ratios are projections over a single shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .. import dims
from ..money import ABS_FLOOR, MONEY, SUBTOTAL_REL_TOLERANCE, close, relative_error_pct

PREFIX = {"income": "is_", "balance": "bs_", "cashflow": "cf_"}
SLOTS = tuple(dims.slots())


def col_of(statement: str, account: str) -> str:
    return PREFIX[statement] + account


def slot_columns() -> list[str]:
    return [col_of(s, a) for s, a in SLOTS]


def to_wide(ledger: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """One row per company and year. Clustering on the company alone lets later windows and
    folds over its years reuse this exchange; a company's rows are bounded by lines x years."""
    aggs = [f"max(CASE WHEN statement = '{s}' AND account = '{a}' THEN value END) AS {col_of(s, a)}" for s, a in SLOTS]
    return ledger.repartition(*keys).groupBy(*keys, "year").agg(*map(F.expr, aggs))


def stacked(rows: Sequence[Sequence[str]], names: Sequence[str]) -> str:
    """A stack() generator: one output row per inner sequence of SQL expressions."""
    return f"stack({len(rows)}, {', '.join(e for r in rows for e in r)}) AS ({', '.join(names)})"


def to_long(wide: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    rows = [(f"'{s}'", f"'{a}'", col_of(s, a)) for s, a in SLOTS]
    return wide.selectExpr(*keys, "year", stacked(rows, ("statement", "account", "value"))).where("value IS NOT NULL")


def signed_sum(statement: str, plus: Sequence[str], minus: Sequence[str]) -> str:
    """Signed total of a subtotal's terms: NULL when a required term is absent or none is present."""
    here = set(dims.accounts_of(statement))
    terms = [(t, "+") for t in plus] + [(t, "-") for t in minus]
    if any(t not in here and t not in dims.OPTIONAL_TERMS for t, _ in terms):
        return f"CAST(NULL AS {MONEY})"
    terms = [(col_of(statement, t), op, t in dims.OPTIONAL_TERMS) for t, op in terms if t in here]
    total = " ".join(f"{op} coalesce({c}, CAST(0 AS {MONEY}))" for c, op, _ in terms)
    required = [c for c, _, optional in terms if not optional]
    known = " AND ".join(f"{c} IS NOT NULL" for c in required) or f"coalesce({', '.join(c for c, _, _ in terms)}) IS NOT NULL"
    return f"CASE WHEN {known} THEN CAST({total} AS {MONEY}) END"


def derive_terms(wide: DataFrame) -> DataFrame:
    """Adds drv_<target> for every subtotal, from the columns as they stand."""
    return wide.selectExpr("*", *[f"{signed_sum(s, p, m)} AS drv_{t}" for t, (s, p, m) in dims.DERIVATIONS.items()])


def fill_derivable(wide: DataFrame) -> DataFrame:
    """Absent subtotals computed level by level; the levels are static, so nothing iterates."""
    out = wide
    for level in dims.levels():
        new = {}
        for t in level:
            s, plus, minus = dims.DERIVATIONS[t]
            c = col_of(s, t)
            new[c] = f"coalesce({c}, {signed_sum(s, plus, minus)}) AS {c}"
        out = out.selectExpr(*[new.get(c, c) for c in out.columns])
    return out


def fill_with_reported(wide: DataFrame) -> DataFrame:
    """The filled wide ledger, keeping each subtotal as reported in rep_<target>."""
    return fill_derivable(wide.selectExpr("*", *[f"{col_of(s, t)} AS rep_{t}" for t, (s, _, _) in dims.DERIVATIONS.items()]))


def filled_ledger(ledger: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Long ledger with derived subtotals added; origin tells which were computed, basis how."""
    subtotals = {(s, t) for t, (s, _, _) in dims.DERIVATIONS.items()}
    wide = to_wide(ledger, keys)
    marked = wide.selectExpr("*", *[f"{col_of(s, t)} AS rep_{col_of(s, t)}" for s, t in sorted(subtotals)])
    rows = []
    for s, a in SLOTS:
        if (s, a) in subtotals:
            computed = f"rep_{col_of(s, a)} IS NULL"
            rows.append((f"'{s}'", f"'{a}'", col_of(s, a), f"CASE WHEN {computed} THEN 'derived' ELSE 'reported' END",
                         f"CASE WHEN {computed} THEN '{basis_text(a)}' END"))
        else:
            rows.append((f"'{s}'", f"'{a}'", col_of(s, a), "'reported'", "CAST(NULL AS STRING)"))
    return (
        fill_derivable(marked)
        .selectExpr(*keys, "year", stacked(rows, ("statement", "account", "value", "origin", "basis")))
        .where("value IS NOT NULL")
    )


def basis_text(target: str) -> str:
    _, plus, minus = dims.DERIVATIONS[target]
    return f"{target} = " + " + ".join(plus) + "".join(f" - {m}" for m in minus)


def cross_check(wide: DataFrame, keys: Sequence[str] = ("company_id",), rel: str = SUBTOTAL_REL_TOLERANCE, floor: str = ABS_FLOOR) -> DataFrame:
    """Reported subtotals beside the value their terms give, for every comparable one."""
    rows = [(f"'{s}'", f"'{t}'", col_of(s, t), f"drv_{t}") for t, (s, _, _) in dims.DERIVATIONS.items()]
    return (
        derive_terms(wide)
        .selectExpr(*keys, "year", stacked(rows, ("statement", "account", "reported", "derived")))
        .where(F.col("reported").isNotNull() & F.col("derived").isNotNull())
        .withColumns(
            {
                "difference": (F.col("reported") - F.col("derived")).cast(MONEY),
                "relative_error_pct": relative_error_pct(F.col("reported"), F.col("derived")),
                "agrees": close(F.col("reported"), F.col("derived"), rel, floor),
            }
        )
    )


def discrepancies(wide: DataFrame, **kw) -> DataFrame:
    return cross_check(wide, **kw).where(~F.col("agrees")).drop("agrees")


def computed_vs_reported(wide: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Each subtotal recomputed beside the reported one, with the required terms it misses."""
    rows = []
    for t, (s, plus, minus) in dims.DERIVATIONS.items():
        here = set(dims.accounts_of(s))
        gaps = [
            f"CASE WHEN {col_of(s, x)} IS NULL THEN '{x}' END" if x in here else f"'{x}'"
            for x in plus + minus
            if x not in dims.OPTIONAL_TERMS
        ]
        missing = f"array_compact(array({', '.join(gaps + ['CAST(NULL AS STRING)'])}))"
        rows.append((f"'{s}'", f"'{t}'", col_of(s, t), f"drv_{t}", missing))
    out = derive_terms(wide).selectExpr(*keys, "year", stacked(rows, ("statement", "account", "reported", "computed", "missing")))
    return out.withColumn("agrees", close(F.col("reported"), F.col("computed"), SUBTOTAL_REL_TOLERANCE))


def comparable_count(wide: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Subtotals both reported and derivable, per company."""
    both = " + ".join(
        f"CAST({col_of(s, t)} IS NOT NULL AND drv_{t} IS NOT NULL AS BIGINT)" for t, (s, _, _) in dims.DERIVATIONS.items()
    )
    return derive_terms(wide).groupBy(*keys).agg(F.expr(f"sum({both})").alias("comparable"))


def validate_accounts(ledger: DataFrame) -> DataFrame:
    """Rows whose account does not belong to their statement."""
    chart = F.broadcast(dims.chart_df(ledger.sparkSession).select("statement", "account"))
    return ledger.join(chart, ["statement", "account"], "left_anti")


def chart_for_statement(ledger: DataFrame, statement: str) -> DataFrame:
    chart = F.broadcast(dims.chart_df(ledger.sparkSession).where(F.col("statement") == statement))
    return ledger.join(chart, ["statement", "account"])


def require(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """Required (company, statement, account, year) cells that are absent."""
    return wanted.join(ledger, ["company_id", "statement", "account", "year"], "left_anti")


def accounts_present(ledger: DataFrame) -> DataFrame:
    """Sorted account names per company, statement and year; bounded by the chart."""
    return ledger.groupBy("company_id", "statement", "year").agg(F.sort_array(F.collect_set("account")).alias("accounts"))


def shared_years(ledger: DataFrame) -> DataFrame:
    return ledger.select("company_id", "year").distinct()


def extend_axis(ledger: DataFrame, axis: DataFrame) -> DataFrame:
    """Keep the rows whose year is on the model's axis."""
    return ledger.join(axis.select("year").distinct(), "year", "left_semi")


def hardcodes(ledger: DataFrame, first_forecast_year: int) -> DataFrame:
    """Reported-origin cells in forecast years."""
    return ledger.where((F.col("origin") == "reported") & (F.col("year") >= first_forecast_year))


def section_total(ledger: DataFrame, sections: dict[str, Sequence[str]]) -> DataFrame:
    """Sum of the present accounts of each section; no row where none is present."""
    spark = ledger.sparkSession
    dim = F.broadcast(dims.local_table(spark, [(k, a) for k, v in sections.items() for a in v], "section string, account string"))
    return ledger.join(dim, "account").groupBy("company_id", "year", "section").agg(F.sum("value").cast(MONEY).alias("total"))


def by_year(keys: Sequence[str] = ("company_id",)):
    return Window.partitionBy(*keys).orderBy("year")


def with_prior(wide: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Adds prev_<column> from the preceding period, and the ordinal n."""
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY year)"
    return wide.selectExpr("*", f"row_number() {over} AS n", *[f"lag({c}) {over} AS prev_{c}" for c in columns])


def growth(wide: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Year-on-year percent change on abs(prior), one HALF_EVEN decimal, with a reason when undefined."""
    rows = [(f"'{s}'", f"'{a}'", col_of(s, a), f"prev_{col_of(s, a)}") for s, a in SLOTS]
    prior = with_prior(wide, slot_columns(), keys)
    v, p = F.col("value"), F.col("prior")
    return (
        prior.selectExpr(*keys, "year", "n", stacked(rows, ("statement", "account", "value", "prior")))
        .where(v.isNotNull())
        .withColumns(
            {
                "growth_pct": F.bround((F.try_divide(v - p, F.abs(p)) * 100).cast("decimal(20,8)"), 1),
                "reason": F.when(F.col("n") == 1, "first period")
                .when(p.isNull(), "prior period not reported")
                .when(p == 0, "prior period is zero"),
            }
        )
        .drop("n")
    )


def common_size(wide: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Each line as a percent of revenue, or of total assets on the balance sheet."""
    base = {"income": "is_revenue", "cashflow": "is_revenue", "balance": "bs_total_assets"}
    rows = [(f"'{s}'", f"'{a}'", col_of(s, a), base[s]) for s, a in SLOTS]
    v, b = F.col("value"), F.col("base")
    return (
        wide.selectExpr(*keys, "year", stacked(rows, ("statement", "account", "value", "base")))
        .where(v.isNotNull())
        .withColumns(
            {
                "common_size_pct": F.bround((F.try_divide(v, b) * 100).cast("decimal(20,8)"), 1),
                "reason": F.when(b.isNull(), "base not reported").when(b == 0, "base is zero"),
            }
        )
    )


def statement_rows(ledger: DataFrame) -> DataFrame:
    """Rows of each statement in chart order, absent rows dropped."""
    chart = F.broadcast(dims.chart_df(ledger.sparkSession).select("statement", "account", "display_name", "display_order"))
    return ledger.join(chart, ["statement", "account"])


def prior_year_pairs(ledger: DataFrame, account: str) -> DataFrame:
    """Value with the one a calendar year earlier; a gap in years gives no pair."""
    w = Window.partitionBy("company_id", "statement", "account").orderBy("year")
    return (
        ledger.where(F.col("account") == account)
        .withColumns({"prev_year": F.lag("year").over(w), "prior": F.lag("value").over(w)})
        .where(F.col("year") == F.col("prev_year") + 1)
        .drop("prev_year")
    )


def series_summary(ledger: DataFrame, account: str, statement: str) -> DataFrame:
    """First, last and total change of one line per company; undefined at a zero start."""
    g = (
        ledger.where((F.col("account") == account) & (F.col("statement") == statement))
        .groupBy("company_id")
        .agg(
            F.min_by("value", "year").alias("first_value"),
            F.max_by("value", "year").alias("last_value"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
        )
    )
    change = (F.col("last_value") - F.col("first_value")) / F.nullif(F.abs(F.col("first_value")), F.lit(0)) * 100
    return g.withColumn("change_pct", F.bround(change.cast("decimal(20,8)"), 1))


def net_income_linkage(wide: DataFrame) -> DataFrame:
    a, b = F.col("is_net_income"), F.col("cf_net_income")
    return wide.where(a.isNotNull() & b.isNotNull()).select(
        "company_id", "year", a.alias("on_income"), b.alias("on_cashflow"), close(a, b).alias("agrees")
    )


def attribution_check(wide: DataFrame) -> DataFrame:
    """Parent plus minority share against net income, where both shares are disclosed."""
    p, m, ni = F.col("is_net_income_to_parent"), F.col("is_net_income_to_minority"), F.col("is_net_income")
    return wide.where(p.isNotNull() & m.isNotNull() & ni.isNotNull()).select(
        "company_id", "year", (p + m).cast(MONEY).alias("attributed"), ni.alias("net_income"), close(p + m, ni).alias("agrees")
    )
