"""Scenario inheritance and driver resolution for every company at once.

A company's scenarios and assumptions are keyed and clustered by company_id; each company holds a
handful of scenarios, so a company's tree is one small map and lineage is a fold over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import dims, layers
from ..money import MONEY
from .ledger import stacked
from .periods import years_array  # noqa: F401


def tree(scenarios: DataFrame) -> DataFrame:
    """One row per company with its scenario -> parent map. Of rows that share a scenario id the first by
    parent counts; tree_violations reports them."""
    rows = scenarios.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("scenario_id", "parent_id"))).alias("rows"))
    return rows.selectExpr(
        "company_id",
        "map_from_entries(filter(rows, (r, i) -> i = 0 OR rows[i - 1].scenario_id <> r.scenario_id)) AS parents",
        "array_distinct(transform(filter(rows, (r, i) -> i > 0 AND rows[i - 1].scenario_id = r.scenario_id), r -> r.scenario_id)) AS repeated",
    )


_PATH = (
    "aggregate(sequence(1, size(parents)), array(scenario_id), (acc, i) -> CASE WHEN parents[element_at(acc, -1)] IS NULL"
    " THEN acc ELSE concat(acc, array(parents[element_at(acc, -1)])) END)"
)


def paths(trees: DataFrame) -> DataFrame:
    """Each scenario with its path to the root."""
    return trees.selectExpr("company_id", "parents", "explode(map_keys(parents)) AS scenario_id").selectExpr(
        "company_id", "parents", "scenario_id", f"{_PATH} AS path"
    )


def scenario_lineage(scenarios: DataFrame) -> DataFrame:
    """Scenario, then its parent, then the parent's parent, with the depth of each."""
    return paths(tree(scenarios)).selectExpr("company_id", "scenario_id", "posexplode(path) AS (depth, ancestor_id)")


def tree_violations(scenarios: DataFrame) -> DataFrame:
    """Repeated ids, circular inheritance, unknown parents, and a missing or parented base."""
    trees = tree(scenarios)
    p = paths(trees)
    repeated = trees.selectExpr("company_id", "explode(repeated) AS scenario_id", "'repeated scenario id' AS problem")
    baseless = trees.where("NOT array_contains(map_keys(parents), 'base')").selectExpr("company_id", "'base' AS scenario_id", "'no base scenario' AS problem")
    return repeated.unionByName(baseless).unionByName(
        p.selectExpr(
            "company_id",
            "scenario_id",
            "CASE WHEN size(path) > size(parents) THEN 'circular inheritance'"
            " WHEN NOT array_contains(map_keys(parents), element_at(path, -1)) THEN 'unknown parent'"
            " WHEN scenario_id <> 'base' AND size(path) = 1 THEN 'no parent'"
            " WHEN scenario_id = 'base' AND size(path) > 1 THEN 'base has a parent' END AS problem",
        )
        .where("problem IS NOT NULL")
    )


def seen_by(scenarios: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Assumption rows repeated for every scenario that inherits them, with their distance."""
    chain = paths(tree(scenarios)).selectExpr("company_id", "scenario_id", "posexplode(array_distinct(path)) AS (depth, owner_id)")
    chain = chain.selectExpr("company_id", "owner_id", "scenario_id", "CAST(depth AS BIGINT) AS depth")
    return assumptions.withColumnRenamed("scenario_id", "owner_id").join(chain, ["company_id", "owner_id"])


def spread(df: DataFrame) -> DataFrame:
    """Clustered on the scenario over all shuffle partitions of the session. A scenario's few rows become hundreds here, so partitions
    must not be merged by the bytes that come in: a task would hold what they become."""
    return layers.spread(df, "company_id", "scenario_id")


EVIDENCE = ("url", "date")  # carried through resolution where the assumptions have them
NO_PERIOD = 0  # the year under which a resolution with no period given is kept


def resolve_all(scenarios: DataFrame, assumptions: DataFrame, years: Sequence[int] | DataFrame) -> DataFrame:
    """The value every scenario uses for every code, per year and for no period given. The years are those stated, or each
    company's own (a table of company_id and forecast_years; a company without a row is resolved for no period only).

    A value scoped to the year wins over an all-years one anywhere on the chain; among equals the
    nearer scenario wins, then the earlier row. With no period, the nearer scenario's first row wins.
    """
    own = isinstance(years, DataFrame)
    ys = "coalesce(forecast_years, CAST(array() AS ARRAY<INT>))" if own else years_array(years)
    pick = ["period", "value", "unit", "status", "source_type", "owner_id AS supplied_by", *[c for c in EVIDENCE if c in assumptions.columns]]
    names = [c.split()[-1] for c in pick]
    seen, axis = seen_by(scenarios, assumptions), []
    if own:
        seen, axis = seen.join(years.select("company_id", "forecast_years"), "company_id", "left"), [F.first("forecast_years").alias("forecast_years")]
    one = spread(seen).select("company_id", "scenario_id", "code", F.expr(f"struct(depth, seq, {', '.join(pick)}) AS c"), *["forecast_years"] * own)
    # a code's rows on one chain are few; they are ordered once and not once per year
    per = one.groupBy("company_id", "scenario_id", "code").agg(F.array_sort(F.collect_list("c")).alias("cs"), *axis)
    per = per.selectExpr(
        "company_id", "scenario_id", "code", "cs[0] AS any_period", "get(filter(cs, c -> c.period IS NULL), 0) AS every_year", "filter(cs, c -> c.period IS NOT NULL) AS dated",
        f"explode(array_union(array({NO_PERIOD}), {ys})) AS year",
    )
    found = per.selectExpr("company_id", "scenario_id", "year", "code", f"CASE WHEN year = {NO_PERIOD} THEN any_period ELSE coalesce(get(filter(dated, c -> c.period = year), 0), every_year) END AS pick")
    order = [n for n in names if n != "period"]
    order[order.index("supplied_by") + 1 : order.index("supplied_by") + 1] = ["depth", "period"]
    return found.where("pick IS NOT NULL").select("company_id", "scenario_id", "year", "code", *[f"pick.{n}" for n in order])


def resolve(scenarios: DataFrame, assumptions: DataFrame, years: Sequence[int]) -> DataFrame:
    return resolve_all(scenarios, assumptions, years).where(F.col("year") != NO_PERIOD)


def resolve_any_period(scenarios: DataFrame, assumptions: DataFrame) -> DataFrame:
    return resolve_all(scenarios, assumptions, ()).where(F.col("year") == NO_PERIOD).drop("year")


def differences(scenarios: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Own values that depart from what the parent resolves to; a new code counts, a restatement does not."""
    parent_view = resolve_any_period(scenarios, assumptions).selectExpr(
        "company_id", "scenario_id AS parent_id", "code", "value AS before"
    )
    own = assumptions.join(scenarios.where("parent_id IS NOT NULL").select("company_id", "scenario_id", "parent_id"), ["company_id", "scenario_id"])
    return (
        own.join(parent_view, ["company_id", "parent_id", "code"], "left")
        .where("before IS NULL OR before <> value")
        .select("company_id", "scenario_id", "parent_id", "code", "period", "before", F.col("value").alias("after"))
    )


def comparison(scenarios: DataFrame, assumptions: DataFrame, forecast: DataFrame, years: Sequence[int], figures: Sequence[str]) -> DataFrame:
    """One row per scenario: the figures of each year side by side, and the drivers in which it departs from its parent."""
    k = ["company_id", "scenario_id"]
    side = forecast.groupBy(*k).agg(*[F.max(F.when(F.col("year") == y, F.col(n))).alias(f"{n}_{y}") for n in figures for y in years])
    codes = differences(scenarios, assumptions).groupBy(*k).agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("differs_in"))
    return scenarios.select(*k).join(side, k, "left").join(codes, k, "left").withColumn("differs_in", F.coalesce("differs_in", F.lit("")))


_STATUS_NAMES = "array(" + ", ".join(f"'{x}'" for x in dims.STATUSES) + ")"
_STATUS_NO = "array_position(" + _STATUS_NAMES + ", status)"
_BLOCKING_NO = "(" + ", ".join(str(dims.STATUSES.index(x) + 1) for x in dims.BLOCKING_STATUSES) + ")"
SOURCE_TYPES = tuple(dims.ENGINE_BASIS)
_SOURCE_NO = "array_position(array(" + ", ".join(f"'{x}'" for x in SOURCE_TYPES) + "), source_type)"


def gate_problems() -> str:
    """SQL array of (choice, problem) over st_ status columns."""
    out = []
    for g in dims.required_choices():
        supplied = " + ".join(f"CAST(st_{c} IS NOT NULL AS INT)" for c in g)
        blocked = "coalesce(" + ", ".join(f"CASE WHEN st_{c} IN {_BLOCKING_NO} THEN concat('{c} is ', {_STATUS_NAMES}[st_{c} - 1]) END" for c in g) + ")"
        out.append(
            f"named_struct('choice', '{'|'.join(g)}', 'problem', CASE WHEN {supplied} = 0 THEN 'missing' WHEN {supplied} > 1 THEN 'ambiguous' ELSE {blocked} END)"
        )
    return f"filter(array({', '.join(out)}), p -> p.problem IS NOT NULL)"


def driver_state(resolved: DataFrame) -> DataFrame:
    """One row per company, scenario and year: usable drivers, status numbers of the required ones
    (st_), usable market inputs (m_) and what is wrong with the others (bad_). Statuses are kept as
    numbers so the aggregation stays a hash aggregation."""
    ok = f"{_STATUS_NO} NOT IN {_BLOCKING_NO}"
    aggs = [f"max(CASE WHEN code = '{d[0]}' AND {ok} THEN value END) AS {d[0]}" for d in dims.DRIVERS]
    aggs += [f"max(CASE WHEN code = '{c}' THEN CAST({_STATUS_NO} AS INT) END) AS st_{c}" for g in dims.required_choices() for c in g]
    aggs += [f"max(CASE WHEN code = '{c}' AND {ok} AND unit = '{u}' THEN value END) AS m_{c}" for c, u, _, _ in dims.MARKET_INPUTS]
    aggs += [f"max(CASE WHEN code = '{c}' AND NOT ({ok} AND unit = '{u}') THEN CAST({_STATUS_NO} AS INT) END) AS bad_{c}" for c, u, _, _ in dims.MARKET_INPUTS]
    aggs += [f"max(CASE WHEN code = 'tax_rate' AND {ok} THEN CAST({_SOURCE_NO} AS INT) END) AS tax_source"]
    return resolved.groupBy("company_id", "scenario_id", "year").agg(*map(F.expr, aggs))


def gate(resolved: DataFrame, scenarios: DataFrame, years: Sequence[int] | DataFrame) -> DataFrame:
    """Per scenario and year, required choices with none, several, or an unusable answer."""
    own = isinstance(years, DataFrame)
    every = scenarios.join(years.select("company_id", "forecast_years"), "company_id") if own else scenarios
    axis = every.selectExpr("company_id", "scenario_id", f"explode({'forecast_years' if own else years_array(years)}) AS year")
    return (
        axis.join(driver_state(resolved), ["company_id", "scenario_id", "year"], "left")
        .selectExpr("company_id", "scenario_id", "year", f"inline({gate_problems()})")
    )


def required_driver_rows(resolved: DataFrame, scenarios: DataFrame, years: Sequence[int] | DataFrame) -> DataFrame:
    """One row per required choice and scenario, satisfied or not, with the problem text."""
    problems = gate(resolved, scenarios, years)
    every = scenarios.selectExpr("company_id", "scenario_id", stacked([("'" + "|".join(g) + "'",) for g in dims.required_choices()], ("choice",)))
    p = problems.groupBy("company_id", "scenario_id", "choice").agg(F.min("problem").alias("problem"), F.count("*").alias("years"))
    return every.join(p, ["company_id", "scenario_id", "choice"], "left").withColumns(
        {"problem": F.coalesce("problem", F.lit("")), "years": F.coalesce("years", F.lit(0).cast("long"))}
    )


def usable(resolved: DataFrame) -> DataFrame:
    return resolved.where(~F.col("status").isin(*dims.BLOCKING_STATUSES))


def driver_wide(resolved: DataFrame) -> DataFrame:
    """Usable driver values as one column per code, per company, scenario and year."""
    return driver_state(resolved).select("company_id", "scenario_id", "year", *[d[0] for d in dims.DRIVERS], "tax_source")


def driver_lookup(resolved: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values for wanted (company, scenario, year, code); found = false is a violation."""
    return wanted.join(resolved, ["company_id", "scenario_id", "year", "code"], "left").withColumn("found", F.col("value").isNotNull())


def pick_driver(drivers: DataFrame, pct: str, amount: str) -> DataFrame:
    """Which of two methods a line uses; both or none is an error."""
    return drivers.selectExpr(
        "company_id", "scenario_id", "year", f"{pct} AS pct", f"{amount} AS amount",
        f"CASE WHEN {pct} IS NOT NULL AND {amount} IS NOT NULL THEN 'both declared' WHEN {amount} IS NOT NULL THEN 'amount'"
        f" WHEN {pct} IS NOT NULL THEN 'percentage' ELSE 'no driver' END AS method",
    )


def optional_driver(drivers: DataFrame, code: str) -> DataFrame:
    """A discretionary driver; absence means it did not happen."""
    if code not in {d[0] for d in dims.DRIVERS if not d[3]}:
        raise ValueError(f"{code} may not default to zero")
    return drivers.selectExpr("company_id", "scenario_id", "year", f"coalesce({code}, CAST(0 AS {MONEY})) AS value")


def duplicate_drivers(assumptions: DataFrame) -> DataFrame:
    """Two values for one (scenario, code, period)."""
    return assumptions.groupBy("company_id", "scenario_id", "code", "period").agg(F.count("*").alias("n")).where("n > 1")


def unused_drivers(assumptions: DataFrame) -> DataFrame:
    """Declared codes nothing computes from."""
    known = [d[0] for d in dims.DRIVERS] + [m[0] for m in dims.MARKET_INPUTS]
    return assumptions.select("company_id", "scenario_id", "code").distinct().where(~F.col("code").isin(known))


def unit_check(assumptions: DataFrame) -> DataFrame:
    """Assumptions whose unit differs from their driver's or market input's."""
    spark = assumptions.sparkSession
    d = dims.driver_df(spark).selectExpr("code", "unit AS expected").unionByName(dims.market_input_df(spark).selectExpr("code", "unit AS expected"))
    return assumptions.join(F.broadcast(d), "code").where("unit <> expected").select("company_id", "scenario_id", "code", "unit", "expected")


def scenario_summary(scenarios: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Own, resolved and differing codes per scenario."""
    k = ["company_id", "scenario_id"]
    own = assumptions.groupBy(k).agg(F.count("*").alias("own"))
    res = resolve_any_period(scenarios, assumptions).groupBy(k).agg(F.count("*").alias("resolved"))
    dif = differences(scenarios, assumptions).groupBy(k).agg(F.count("*").alias("differs"))
    return (
        scenarios.select(*k, "parent_id").join(own, k, "left").join(res, k, "left").join(dif, k, "left")
        .fillna(0, ["own", "resolved", "differs"])
    )


def override(scenarios: DataFrame, assumptions: DataFrame, changes: DataFrame) -> DataFrame:
    """Child values with inherited unit and lineage; refused rows carry the problem.

    changes: company_id, scenario_id, code, value, period.
    """
    parent = resolve_any_period(scenarios, assumptions).selectExpr(
        "company_id", "scenario_id AS parent_id", "code", "unit", "supplied_by", "value AS inherited_value"
    )
    c = changes.join(scenarios.select("company_id", "scenario_id", "parent_id"), ["company_id", "scenario_id"], "left")
    return c.join(parent, ["company_id", "parent_id", "code"], "left").selectExpr(
        "company_id", "scenario_id", "code", "period", "value", "unit", "inherited_value", "supplied_by AS inherited_from",
        "CASE WHEN supplied_by IS NOT NULL THEN concat(supplied_by, ':', code) END AS overrides",
        "'Scenario Override' AS source_type",
        "CASE WHEN parent_id IS NULL THEN 'no parent to override' WHEN supplied_by IS NULL THEN 'parent does not carry this code' END AS problem",
    )


def with_assumptions(assumptions: DataFrame, new: DataFrame) -> DataFrame:
    """Key-replace by (company, scenario, code, period), keeping everything else."""
    on = [assumptions[c].eqNullSafe(new[c]) for c in ("company_id", "scenario_id", "code", "period")]
    return assumptions.join(new, on, "left_anti").unionByName(new, allowMissingColumns=True)


def name_violations(scenarios: DataFrame) -> DataFrame:
    """Names that claim a likelihood without a sourced probability."""
    words = r"(?i)\b(" + "|".join(dims.PROBABILITY_WORDS) + r")\b"
    return scenarios.withColumn(
        "claim",
        F.coalesce(
            F.nullif(F.lower(F.regexp_extract("name", words, 1)), F.lit("")),
            F.nullif(F.lower(F.regexp_extract("name", dims.PERCENTILE_PATTERN, 0)), F.lit("")),
        ),
    ).where("claim IS NOT NULL")


def probability_violations(p: DataFrame) -> DataFrame:
    """A probability needs a value in [0, 1], a source and a date."""
    return p.withColumn(
        "problem",
        F.when((F.col("value") < 0) | (F.col("value") > 1), "outside [0, 1]")
        .when(F.coalesce(F.trim("source"), F.lit("")) == "", "no source")
        .when(F.coalesce(F.trim("date"), F.lit("")) == "", "no date"),
    ).where("problem IS NOT NULL")


def evidence_gaps(assumptions: DataFrame) -> DataFrame:
    """Evidence each source type requires and the row lacks.

    Needs columns document_id, page, url, date, measured_over, overrides."""
    blank = "coalesce(trim({0}), '') = ''"
    no_cite = f"({blank.format('document_id')} OR page IS NULL)"
    need = [
        f"CASE WHEN source_type = 'Company Filing' AND {no_cite} THEN 'document and page' END",
        f"CASE WHEN source_type = 'Company Guidance' AND {no_cite} AND {blank.format('url')} THEN 'document and page, or url' END",
        f"CASE WHEN source_type IN ('Company Guidance', 'External Market Data') AND {blank.format('date')} THEN 'date' END",
        f"CASE WHEN source_type = 'External Market Data' AND {blank.format('url')} THEN 'url' END",
        "CASE WHEN source_type = 'Historical Driver' AND coalesce(size(measured_over), 0) <= 0 THEN 'measured periods' END",
        f"CASE WHEN source_type = 'Scenario Override' AND {blank.format('overrides')} THEN 'overridden assumption' END",
    ]
    return assumptions.withColumn("missing", F.expr(f"array_compact(array({', '.join(need)}))"))


def evidence_text() -> str:
    """SQL for a readable citation."""
    return (
        "concat_ws(', ', nullif(trim(document_id), ''), CASE WHEN page IS NOT NULL THEN concat('p', page) END, nullif(trim(url), ''),"
        " nullif(trim(date), ''), CASE WHEN size(measured_over) > 0 THEN concat('measured over ', array_join(measured_over, ', ')) END)"
    )
