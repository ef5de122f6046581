"""Registered queries: schedules, scenarios, forecast, valuation, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import checks as C
from ..operators import forecast as FC
from ..operators import ledger as L
from ..operators import periods as PD
from ..operators import scenarios as S
from ..operators import schedules as H
from ..operators import valuation as V
from ..sources import derived as D
from .duck import CTES, M, R, _PREFIX, cte, q, sql, values
from .model import Model
from .q_ledger import _drv, close_sql, full
from .registry import as_double, dbl, register, sd

K = "company_id, scenario_id"


def model(spark, sf, **kw) -> Model:
    return Model(D.ledger(spark, sf), D.scenarios(spark, sf), D.assumptions(spark, sf), D.FORECAST_YEARS, **kw)


def even(expr: str, name: str, places: int = 1) -> str:
    return f"CAST(round_even(CAST({expr} AS DECIMAL(20,8)), {places}) AS DOUBLE) AS {name}"


# ---- historical schedules -------------------------------------------------------------------
cte(
    "prevd",
    "SELECT *, row_number() OVER w AS n, " + ", ".join(f"lag({c}) OVER w AS prev_{c}" for c in ("bs_ppe_net", "bs_intangibles", "bs_debt", "bs_retained_earnings", "bs_common_equity", "bs_cash"))
    + ", bool_or(cf_depreciation IS NOT NULL) OVER (PARTITION BY company_id) AS splits FROM derived WINDOW w AS (PARTITION BY company_id ORDER BY year)",
    "derived",
)
_sum = lambda cols: "CASE WHEN " + " OR ".join(f"{c} IS NOT NULL" for c in cols) + " THEN " + " + ".join(f"COALESCE({c}, 0)" for c in cols) + " END"
_OA = [f"bs_{a}" for a in dims.OPERATING_CURRENT_ASSETS]
_OL = [f"bs_{a}" for a in dims.OPERATING_CURRENT_LIABILITIES]
cte("wc", f"SELECT company_id, year, cf_change_in_nwc AS reported, {_sum(_OA)} AS oa, {_sum(_OL)} AS ol, concat_ws(', ', "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c[3:]}' END" for c in _OA + _OL) + ") AS absent FROM derived", "derived")
cte("wc2", "SELECT *, oa - ol AS nwc, (oa - ol) - lag(oa - ol) OVER (PARTITION BY company_id ORDER BY year) AS dnwc, row_number() OVER (PARTITION BY company_id ORDER BY year) AS n FROM wc", "wc")


@register("h01_wc_lines", sql("SELECT company_id, year, " + sd("oa", "operating_assets") + ", " + sd("ol", "operating_liabilities") + ", " + sd("nwc", "nwc") + ", " + sd("dnwc", "change_in_nwc") + ", absent FROM wc2", "wc2"))
def h01(spark, sf):
    w = H.working_capital(full(spark, sf)).withColumn("absent", F.array_join("absent", ", "))
    return as_double(w.drop("n", "reported_change"), "operating_assets", "operating_liabilities", "nwc", "change_in_nwc")


_DAYS_SQL = " UNION ALL ".join(
    f"SELECT company_id, year, '{n}' AS driver, {even(f'CASE WHEN {f} <> 0 THEN {b} / {f} * 365 END', 'days')},"
    f" CASE WHEN {b} IS NULL THEN 'balance not reported' WHEN {f} IS NULL THEN 'flow not reported' WHEN {f} = 0 THEN 'flow is zero' END AS reason FROM derived"
    for n, b, f in H.DAYS
)


@register("h02_days_drivers", sql(_DAYS_SQL, "derived"))
def h02(spark, sf):
    return H.days_drivers(full(spark, sf)).withColumn("days", F.col("days").cast("double"))


@register("h03_nwc_reconcile", sql("SELECT company_id, year, " + sd("-dnwc", "computed") + ", " + sd("reported", "reported") + ", " + sd("-dnwc - reported", "unexplained") + " FROM wc2 WHERE n > 1", "wc2"))
def h03(spark, sf):
    return as_double(H.nwc_reconcile(full(spark, sf)).drop("schedule", "absent"), "computed", "reported", "unexplained")


def _roll_sql() -> str:
    parts = []
    for name, acc, moves in dims.ROLLFORWARDS:
        cols, labels = [], []
        for st, a, mult, label in moves:
            c, lab = {"income": "is_", "cashflow": "cf_"}[st] + a, f"'{label}'"
            if a == "depreciation_amortization":
                c = f"(CASE WHEN splits THEN cf_depreciation ELSE {c} END)"
                lab = f"(CASE WHEN splits THEN 'Depreciation' ELSE '{label}' END)"
            cols.append(f"COALESCE({mult} * {c}, 0)")
            labels.append(f"CASE WHEN {c} IS NULL THEN {lab} END")
        parts.append(
            f"SELECT company_id, year, '{name}' AS schedule, prev_bs_{acc} AS opening, {' + '.join(cols)} AS movements, bs_{acc} AS reported_ending,"
            f" prev_bs_{acc} + {' + '.join(cols)} AS computed_ending, concat_ws(', ', {', '.join(labels)}) AS absent FROM prevd WHERE n > 1"
        )
    return " UNION ALL ".join(parts)


cte("roll", _roll_sql(), "prevd")


@register("h04_rollforward", sql("SELECT company_id, year, schedule, " + ", ".join(sd(c, c) for c in ("opening", "movements", "computed_ending", "reported_ending")) + ", " + sd("computed_ending - reported_ending", "unexplained") + ", absent FROM roll", "roll"))
def h04(spark, sf):
    r = H.rollforward(full(spark, sf)).withColumn("absent", F.array_join("absent", ", "))
    return as_double(r, "opening", "movements", "computed_ending", "reported_ending", "unexplained")


for _i, (_n, *_r) in enumerate(dims.ROLLFORWARDS):
    def _roll_one(spark, sf, name=_n):
        r = H.rollforward(full(spark, sf)).where(F.col("schedule") == name)
        return as_double(r.select("company_id", "year", "opening", "computed_ending", "unexplained"), "opening", "computed_ending", "unexplained")

    register(f"h0{5 + _i}_{_n}", sql("SELECT company_id, year, " + sd("opening", "opening") + ", " + sd("computed_ending", "computed_ending") + ", "
             + sd("computed_ending - reported_ending", "unexplained") + f" FROM roll WHERE schedule = '{_n}'", "roll"))(_roll_one)


@register("h10_implied_interest", sql(
    " UNION ALL ".join(
        f"SELECT company_id, year, '{b}' AS basis, {sd(f'CAST(CASE WHEN {d} <> 0 THEN is_interest_expense / {d} END AS DECIMAL(20,8))', 'rate', 6)} FROM prevd WHERE n > 1"
        for b, d in (("beginning", "prev_bs_debt"), ("average", "((prev_bs_debt + bs_debt) / 2)"))), "prevd"))
def h10(spark, sf):
    return as_double(H.implied_interest(full(spark, sf)).select("company_id", "year", "basis", "rate"), "rate", places=6)


cte("tax", "SELECT company_id, year, is_pretax_income AS pretax, is_taxes AS tax, CAST(is_taxes / nullif(is_pretax_income, 0) AS DECIMAL(20,8)) AS rate FROM derived", "derived")


@register("h11_effective_tax", sql(
    "SELECT company_id, year, " + sd("rate", "rate", 6) + ", CASE WHEN pretax IS NULL OR tax IS NULL THEN 'not reported: ' || concat_ws(' and ', CASE WHEN pretax IS NULL THEN 'pretax income' END, CASE WHEN tax IS NULL THEN 'tax expense' END)"
    " WHEN pretax = 0 THEN 'pretax income is zero' WHEN pretax < 0 THEN 'pretax income is negative' WHEN rate < 0 OR rate >= 1 THEN 'rate outside [0, 1)' END AS reason,"
    " COALESCE(rate >= 0 AND rate < 1, FALSE) AS usable FROM tax", "tax"))
def h11(spark, sf):
    return as_double(H.effective_tax(full(spark, sf)).select("company_id", "year", "rate", "reason", "usable"), "rate", places=6)


@register("a19_latest_usable_rate", sql("SELECT company_id, " + sd("arg_max(rate, year)", "rate", 6) + ", max(year) AS year FROM tax WHERE rate >= 0 AND rate < 1 GROUP BY company_id", "tax"))
def a19(spark, sf):
    return as_double(H.latest_usable_rate(H.effective_tax(full(spark, sf))), "rate", places=6)


_LACKING = "array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(absent, ', '))), lambda x: x <> ''))), ', ')"


@register("h12_availability", sql(
    "SELECT company_id, schedule, CASE WHEN no_opening = periods THEN 'UNAVAILABLE' WHEN no_opening > 0 OR names <> '' THEN 'PARTIAL' ELSE 'AVAILABLE' END AS availability, CASE WHEN no_opening = periods THEN 'no period has an opening balance'"
    " WHEN no_opening > 0 OR names <> '' THEN concat_ws('; ', CASE WHEN names <> '' THEN 'not reported: ' || names END, CASE WHEN no_opening > 0 THEN 'periods without opening: ' || no_opening END) ELSE '' END AS reason FROM ("
    f"SELECT company_id, schedule, count(*) AS periods, count(*) FILTER (WHERE computed_ending IS NULL) AS no_opening, {_LACKING} AS names FROM roll GROUP BY 1, 2)", "roll"))
def h12(spark, sf):
    return H.availability(H.rollforward(full(spark, sf)))


@register("h13_unavailable_reasons", sql("SELECT company_id, s.schedule, s.reason FROM (SELECT DISTINCT company_id FROM ledger), (" + values(H.UNAVAILABLE, "schedule, reason", "s") + ") s", "ledger"))
def h13(spark, sf):
    rows = [(f"'{a}'", f"'{b}'") for a, b in H.UNAVAILABLE]
    return D.ledger(spark, sf).select("company_id").distinct().selectExpr("company_id", L.stacked(rows, ("schedule", "reason")))


cte("schedrows",
    " UNION ALL ".join(f"SELECT company_id, year, schedule, '{c}' AS line, CAST({e} AS {M}) AS value FROM roll" for c, e in (("opening", "opening"), ("movements", "movements"), ("computed_ending", "computed_ending"), ("reported_ending", "reported_ending"), ("unexplained", "computed_ending - reported_ending")))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT company_id, year, 'working_capital', '{c}', {e} FROM wc2" for c, e in (("operating_assets", "oa"), ("operating_liabilities", "ol"), ("nwc", "nwc"), ("change_in_nwc", "dnwc")))
    + f" UNION ALL SELECT company_id, year, 'days', driver, CAST(days AS {M}) FROM ({_DAYS_SQL})"
    + f" UNION ALL SELECT company_id, year, 'tax', 'effective_rate', CAST(rate AS {M}) FROM tax"
    + f" UNION ALL SELECT company_id, year, 'interest', basis, CAST(rate AS {M}) FROM ("
    + " UNION ALL ".join(f"SELECT company_id, year, '{b}' AS basis, CAST(CASE WHEN {d} <> 0 THEN is_interest_expense / {d} END AS DECIMAL(20,8)) AS rate FROM prevd WHERE n > 1" for b, d in (("beginning", "prev_bs_debt"), ("average", "((prev_bs_debt + bs_debt) / 2)"))) + ")",
    "roll", "wc2", "tax", "prevd", "derived")


@register("h14_schedule_set", sql(
    "SELECT schedule, line, CAST(count(value) AS BIGINT) AS periods, " + sd("sum(value)", "total", 2) + " FROM ("
    "SELECT schedule, line, value FROM schedrows"
    + ") GROUP BY schedule, line", "schedrows"))
def h14(spark, sf):
    s = H.schedule_set(full(spark, sf))
    return as_double(s.groupBy("schedule", "line").agg(F.count("value").alias("periods"), F.sum("value").alias("total")), "total", places=2)


@register("a16_total_unexplained", sql("SELECT company_id, schedule, " + sd("CASE WHEN count(*) = count(computed_ending - reported_ending) THEN sum(computed_ending - reported_ending) END", "total_unexplained") + " FROM roll GROUP BY 1, 2", "roll"))
def a16(spark, sf):
    return as_double(H.total_unexplained(H.rollforward(full(spark, sf))), "total_unexplained")


@register("h15_schedule_rows", sql("SELECT company_id, year, schedule, line, " + sd("value", "value") + " FROM schedrows", "schedrows"))
def h15(spark, sf):
    """Every schedule line of every company and year; an absent figure stays a row without a value."""
    return as_double(H.schedule_set(full(spark, sf)), "value")


@register("w07_chain_check", sql(
    "SELECT company_id, year, schedule, " + close_sql("opening", "prev", floor="'1'") + " AS agrees FROM (SELECT *, lag(reported_ending) OVER (PARTITION BY company_id, schedule ORDER BY year) AS prev FROM roll) WHERE prev IS NOT NULL AND opening IS NOT NULL", "roll"))
def w07(spark, sf):
    return H.chain_check(H.rollforward(full(spark, sf))).select("company_id", "year", "schedule", "agrees")


_REC = "SELECT company_id, schedule, computed_ending AS computed, reported_ending AS reported FROM roll UNION ALL SELECT company_id, 'working_capital', -dnwc, reported FROM wc2 WHERE n > 1"


@register("c12_schedule_reconciles", sql(
    "SELECT company_id, schedule, CAST(checked AS BIGINT) AS checked, CAST(failed AS BIGINT) AS failed, CAST(exact AS BIGINT) AS exact, CASE WHEN checked = 0 THEN 'SKIP' WHEN failed > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ("
    "SELECT company_id, schedule, count(computed - reported) AS checked, count(*) FILTER (WHERE NOT " + close_sql("computed", "reported") + ") AS failed, count(*) FILTER (WHERE computed = reported) AS exact"
    f" FROM ({_REC}) GROUP BY 1, 2)", "roll", "wc2"))
def c12(spark, sf):
    return H.reconcile(H.reconciliations(full(spark, sf))).drop("within_tolerance")


@register("m14_propose_drivers", sql(
    "SELECT company_id, driver AS code, CAST(days AS DOUBLE) AS value, year AS measured_year FROM (SELECT * FROM (" + _DAYS_SQL + ") QUALIFY year = max(year) OVER (PARTITION BY company_id)) WHERE days IS NOT NULL"
    " UNION ALL SELECT company_id, 'interest_rate_on_debt', " + sd("arg_min(CAST(is_interest_expense / prev_bs_debt AS DECIMAL(20,8)), year)", "value", 6) + ", min(year) FROM prevd WHERE n > 1 AND is_interest_expense IS NOT NULL AND prev_bs_debt <> 0 GROUP BY company_id"
    " UNION ALL SELECT company_id, 'tax_rate', " + sd("arg_max(rate, year)", "value", 6) + ", max(year) FROM tax WHERE rate >= 0 AND rate < 1 GROUP BY company_id"
    " UNION ALL SELECT company_id, 'depreciation_pct_beginning_ppe', " + sd("arg_min(CAST(CASE WHEN splits THEN cf_depreciation ELSE cf_depreciation_amortization END / prev_bs_ppe_net AS DECIMAL(20,8)), year)", "value", 6)
    + ", min(year) FROM prevd WHERE prev_bs_ppe_net <> 0 AND CASE WHEN splits THEN cf_depreciation ELSE cf_depreciation_amortization END IS NOT NULL GROUP BY company_id", "derived", "prevd", "tax"))
def m14(spark, sf):
    return as_double(H.propose_drivers(full(spark, sf)).select("company_id", "code", "value", "measured_year"), "value", places=6)


@register("m15_unproposable", sql("SELECT company_id, code, reason FROM (SELECT company_id, bs_other_current_assets AS a, bs_other_current_liabilities AS l FROM derived QUALIFY year = max(year) OVER (PARTITION BY company_id)), ("
    + values(H.NOT_MEASURABLE, "code, reason", "n") + ") n WHERE (code <> 'other_current_assets_pct_revenue' OR a IS NULL) AND (code <> 'other_current_liabilities_pct_revenue' OR l IS NULL)", "derived"))
def m15(spark, sf):
    return H.unproposable(full(spark, sf))


# ---- scenarios and drivers --------------------------------------------------------------------
@register("j16_scenario_lineage", sql(f"SELECT {K}, ancestor_id, CAST(depth AS INTEGER) AS depth FROM lineage", "lineage"))
def j16(spark, sf):
    return S.scenario_lineage(D.scenarios(spark, sf))


@register("j17_resolve_scenario", sql(f"SELECT {K}, year, code, " + sd("value", "value", 6) + ", supplied_by, status FROM resolved", "resolved"))
def j17(spark, sf):
    r = S.resolve(D.scenarios(spark, sf), D.assumptions(spark, sf), D.FORECAST_YEARS)
    return as_double(r.select("company_id", "scenario_id", "year", "code", "value", "supplied_by", "status"), "value", places=6)


cte("anyres",
    "SELECT * FROM (SELECT l.company_id, l.scenario_id, a.code, a.value, a.unit, a.status, a.period, l.ancestor_id AS supplied_by, row_number() OVER (PARTITION BY l.company_id, l.scenario_id, a.code ORDER BY l.depth, a.seq) AS rn"
    " FROM lineage l JOIN assumption a ON a.company_id = l.company_id AND a.scenario_id = l.ancestor_id) WHERE rn = 1", "lineage", "assumption")
cte("diffs",
    "SELECT a.company_id, a.scenario_id, s.parent_id, a.code, a.period, p.value AS before, a.value AS after FROM assumption a JOIN scenario s ON s.company_id = a.company_id AND s.scenario_id = a.scenario_id"
    " LEFT JOIN anyres p ON p.company_id = a.company_id AND p.scenario_id = s.parent_id AND p.code = a.code WHERE s.parent_id IS NOT NULL AND (p.value IS NULL OR p.value <> a.value)", "anyres", "scenario")


_EXTRA_SCENARIOS = ((0, "upside", "downside"), (1, "orphan", "nowhere"), (2, "loop_a", "loop_b"), (2, "loop_b", "loop_a"), (3, "free", None))


@register("j16_tree_violations",
    "SELECT s_suppkey AS company_id, v.scenario_id, v.problem FROM supplier JOIN (VALUES (0, 'upside', 'repeated scenario id'), (1, 'orphan', 'unknown parent'), (2, 'loop_a', 'circular inheritance'),"
    " (2, 'loop_b', 'circular inheritance'), (3, 'free', 'no parent')) AS v(m, scenario_id, problem) ON s_suppkey % 5 = v.m")
def j16_violations(spark, sf):
    """Trees with a repeated id, an unknown parent, a circle and a parentless scenario, one kind per company."""
    good = D.scenarios(spark, sf)
    cells = ", ".join(f"{m}, '{s}', CAST({q(p)} AS STRING)" for m, s, p in _EXTRA_SCENARIOS)
    extra = good.select("company_id").distinct().selectExpr("company_id", f"stack({len(_EXTRA_SCENARIOS)}, {cells}) AS (m, scenario_id, parent_id)")
    extra = extra.where("company_id % 5 = m").selectExpr("company_id", "scenario_id", "parent_id", "scenario_id AS name")
    return S.tree_violations(good.unionByName(extra))


@register("j18_scenario_differences", sql(f"SELECT {K}, parent_id, code, period, " + sd("before", "before", 6) + ", " + sd("after", "after", 6) + " FROM diffs", "diffs"))
def j18(spark, sf):
    return as_double(S.differences(D.scenarios(spark, sf), D.assumptions(spark, sf)), "before", "after", places=6)


_CH = values([("|".join(g), c) for g in dims.required_choices() for c in g], "choice, code", "ch")
_BLOCK = "('Draft', 'Needs Source', 'Rejected')"
cte("gatep",
    "SELECT company_id, scenario_id, year, choice, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN blocked IS NOT NULL THEN blocked END AS problem FROM ("
    "SELECT s.company_id, s.scenario_id, f.year, ch.choice, count(r.code) AS n, min(CASE WHEN r.status IN " + _BLOCK + " THEN r.code || ' is ' || r.status END) AS blocked"
    " FROM scenario s, fyears f, (" + _CH + ") ch LEFT JOIN resolved r ON r.company_id = s.company_id AND r.scenario_id = s.scenario_id AND r.year = f.year AND r.code = ch.code"
    " GROUP BY 1, 2, 3, 4)", "scenario", "fyears", "resolved")


@register("j27_missing_required", sql(f"SELECT {K}, year, choice, problem FROM gatep WHERE problem IS NOT NULL", "gatep"))
def j27(spark, sf):
    m = model(spark, sf)
    return S.gate(m.resolved, m.scenarios, m.years)


@register("m16_required_driver_rows", sql(f"SELECT {K}, choice, COALESCE(min(problem), '') AS problem, CAST(count(problem) AS BIGINT) AS years FROM gatep GROUP BY 1, 2, 3", "gatep"))
def m16(spark, sf):
    m = model(spark, sf)
    return S.required_driver_rows(m.resolved, m.scenarios, m.years)


@register("m17_scenario_summary", sql(
    "SELECT s.company_id, s.scenario_id, s.parent_id, (SELECT count(*) FROM assumption a WHERE a.company_id = s.company_id AND a.scenario_id = s.scenario_id) AS own,"
    " (SELECT count(*) FROM anyres r WHERE r.company_id = s.company_id AND r.scenario_id = s.scenario_id) AS resolved,"
    " (SELECT count(*) FROM diffs d WHERE d.company_id = s.company_id AND d.scenario_id = s.scenario_id) AS differs FROM scenario s", "scenario", "anyres", "diffs"))
def m17(spark, sf):
    return S.scenario_summary(D.scenarios(spark, sf), D.assumptions(spark, sf))


@register("m13_override_assumption", sql(
    f"SELECT c.company_id, c.scenario_id, c.code, " + sd("c.value", "value", 6) + ", p.unit, p.supplied_by AS inherited_from, p.supplied_by || ':' || c.code AS overrides,"
    " CASE WHEN s.parent_id IS NULL THEN 'no parent to override' WHEN p.supplied_by IS NULL THEN 'parent does not carry this code' END AS problem FROM ("
    " SELECT company_id, scenario_id, code, value FROM scenario, (SELECT 'beta' AS code, CAST(1.5 AS DECIMAL(25,8)) AS value UNION ALL SELECT 'no_such_driver', CAST(1 AS DECIMAL(25,8)))) c"
    " JOIN scenario s USING (company_id, scenario_id) LEFT JOIN anyres p ON p.company_id = c.company_id AND p.scenario_id = s.parent_id AND p.code = c.code", "scenario", "anyres"))
def m13(spark, sf):
    sc = D.scenarios(spark, sf)
    changes = sc.selectExpr("company_id", "scenario_id", "stack(2, 'beta', CAST(1.5 AS DECIMAL(25,8)), 'no_such_driver', CAST(1 AS DECIMAL(25,8))) AS (code, value)", ).selectExpr("*", "CAST(NULL AS INT) AS period")
    o = S.override(sc, D.assumptions(spark, sf), changes)
    return as_double(o.select("company_id", "scenario_id", "code", "value", "unit", "inherited_from", "overrides", "problem"), "value", places=6)


cte("drvw",
    f"SELECT {K}, year, " + ", ".join(f"max(CASE WHEN code = '{d[0]}' THEN value END) AS {d[0]}" for d in dims.DRIVERS)
    + f", max(CASE WHEN code = 'tax_rate' THEN source_type END) AS tax_source_type FROM resolved WHERE status NOT IN {_BLOCK} GROUP BY {K}, year", "resolved")


@register("j13_driver_lookup", sql(
    "SELECT s.company_id, s.scenario_id, f.year, 'tax_rate' AS code, " + sd("r.value", "value", 6) + ", r.value IS NOT NULL AS found FROM scenario s, fyears f LEFT JOIN resolved r ON r.company_id = s.company_id AND r.scenario_id = s.scenario_id AND r.year = f.year AND r.code = 'tax_rate'", "scenario", "fyears", "resolved"))
def j13(spark, sf):
    m = model(spark, sf)
    wanted = m.scenarios.selectExpr("company_id", "scenario_id", f"explode({S.years_array(m.years)}) AS year", "'tax_rate' AS code")
    return as_double(S.driver_lookup(m.resolved, wanted).select("company_id", "scenario_id", "year", "code", "value", "found"), "value", places=6)


@register("j14_pick_driver", sql(f"SELECT {K}, year, CASE WHEN cogs_pct_revenue IS NOT NULL AND cogs_amount IS NOT NULL THEN 'both declared' WHEN cogs_amount IS NOT NULL THEN 'amount' WHEN cogs_pct_revenue IS NOT NULL THEN 'percentage' ELSE 'no driver' END AS method FROM drvw", "drvw"))
def j14(spark, sf):
    return S.pick_driver(S.driver_wide(model(spark, sf).resolved), "cogs_pct_revenue", "cogs_amount").drop("pct", "amount")


@register("j15_optional_driver", sql(f"SELECT {K}, year, " + sd("COALESCE(acquisitions, 0)", "value") + " FROM drvw", "drvw"))
def j15(spark, sf):
    return as_double(S.optional_driver(S.driver_wide(model(spark, sf).resolved), "acquisitions"), "value")


@register("p34_status_blocks", sql(f"SELECT {K}, code, status, status IN {_BLOCK} AS blocks FROM assumption", "assumption"))
def p34(spark, sf):
    return D.assumptions(spark, sf).select("company_id", "scenario_id", "code", "status", F.col("status").isin(*dims.BLOCKING_STATUSES).alias("blocks"))


@register("p35_engine_basis", sql("SELECT basis, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM assumption JOIN (" + values(list(dims.ENGINE_BASIS.items()), "source_type, basis", "b") + ") b USING (source_type) GROUP BY basis", "assumption"))
def p35(spark, sf):
    b = F.broadcast(dims.local_table(spark, list(dims.ENGINE_BASIS.items()), "source_type string, basis string"))
    return D.assumptions(spark, sf).join(b, "source_type").groupBy("basis").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


@register("p36_applies_to", sql(f"SELECT {K}, code, year FROM assumption, fyears WHERE period IS NULL OR period = year", "assumption", "fyears"))
def p36(spark, sf):
    return D.assumptions(spark, sf).selectExpr("company_id", "scenario_id", "code", f"explode(CASE WHEN period IS NULL THEN {S.years_array(D.FORECAST_YEARS)} ELSE array_intersect(array(period), {S.years_array(D.FORECAST_YEARS)}) END) AS year")


@register("p37_scenario_name_rules", sql("SELECT company_id, scenario_id, regexp_extract(lower(name), '\\bp\\s?\\d{1,3}\\b') AS claim FROM scenario WHERE regexp_matches(lower(name), '\\bp\\s?\\d{1,3}\\b|\\b(" + "|".join(dims.PROBABILITY_WORDS) + ")\\b')", "scenario"))
def p37(spark, sf):
    return S.name_violations(D.scenarios(spark, sf)).select("company_id", "scenario_id", "claim")


@register("p38_driver_unit_check", sql(
    f"SELECT {K}, code, unit, expected FROM (SELECT {K}, code, CASE WHEN code = 'beta' AND company_id % 3 = 0 THEN 'multiple' ELSE unit END AS unit FROM assumption) JOIN ("
    + values([(d[0], d[1]) for d in dims.DRIVERS] + [(m[0], m[1]) for m in dims.MARKET_INPUTS], "code, expected", "e") + ") e USING (code) WHERE unit <> expected", "assumption"))
def p38(spark, sf):
    a = D.assumptions(spark, sf).withColumn("unit", F.expr("CASE WHEN code = 'beta' AND company_id % 3 = 0 THEN 'multiple' ELSE unit END"))
    return S.unit_check(a)


@register("l03_unique_driver", sql("SELECT company_id, scenario_id, code, CAST(count(*) AS BIGINT) AS n FROM assumption GROUP BY 1, 2, 3 HAVING count(*) > 1", "assumption"))
def l03(spark, sf):
    # Periods dropped on purpose, so that per-year rows of one code collide.
    a = D.assumptions(spark, sf).withColumn("period", F.lit(None).cast("int"))
    return S.duplicate_drivers(a).drop("period")


@register("a13_by_basis", sql("SELECT company_id, source_type, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM assumption GROUP BY 1, 2", "assumption"))
def a13(spark, sf):
    return D.assumptions(spark, sf).groupBy("company_id", "source_type").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


@register("l12_driver_dimension", sql("SELECT code, required, CAST(count(*) AS BIGINT) AS n FROM assumption JOIN (" + values([(d[0], d[3]) for d in dims.DRIVERS], "code, required", "d").replace("'True'", "TRUE") + ") d USING (code) GROUP BY 1, 2", "assumption"))
def l12(spark, sf):
    return D.assumptions(spark, sf).join(F.broadcast(dims.driver_df(spark).select("code", "required")), "code").groupBy("code", "required").agg(F.count("*").alias("n"))


# Two of three companies misspell a code; what nothing computes from is reported.
_MISSPELT = "CASE WHEN code = 'dpo' AND company_id % 3 = 1 THEN 'days_payable' WHEN code = 'terminal_growth' AND company_id % 3 = 2 THEN 'termnal_growth' ELSE code END"


@register("j25_unused_drivers", sql(f"SELECT DISTINCT {K}, code FROM (SELECT {K}, {_MISSPELT} AS code FROM assumption) WHERE code IN ('days_payable', 'termnal_growth')", "assumption"))
def j25(spark, sf):
    return S.unused_drivers(D.assumptions(spark, sf).withColumn("code", F.expr(_MISSPELT)))


# ---- forecast ---------------------------------------------------------------------------------
cte("base2", "SELECT company_id, year AS last_actual, " + ", ".join(f"{c} AS b_{n}" for c, n in FC.REQUIRED_BASE) + ", " + ", ".join(f"bs_{a} AS b_{a}" for a in FC.CARRIED)
    + " FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS rk FROM derived) WHERE rk = 1", "derived")
cte("fstatus",
    f"SELECT s.company_id, s.scenario_id, CASE WHEN b.last_actual + 1 <> {D.FORECAST_YEARS[0]} THEN 'periods' WHEN p.n > 0 THEN 'drivers' WHEN " + " OR ".join(f"b.b_{n} IS NULL" for _, n in FC.REQUIRED_BASE)
    + " THEN 'opening balances' ELSE 'ok' END AS state FROM scenario s LEFT JOIN (SELECT company_id, scenario_id, count(*) AS n FROM gatep WHERE problem IS NOT NULL GROUP BY 1, 2) p USING (company_id, scenario_id)"
    " LEFT JOIN base2 b ON b.company_id = s.company_id", "scenario", "gatep", "base2")
_c = lambda e: f"CAST({e} AS {M})"
_mul = lambda a, b: f"CAST({a} * CAST({b} AS {R}) AS {M})"
_rev = _mul("s.revenue", "1 + d.revenue_growth")
_capex = f"COALESCE(d.capex_amount, {_mul(_rev, 'd.capex_pct_revenue')})"
_dep = _mul("s.ppe_net", "d.depreciation_pct_beginning_ppe")
cte("fold",
    "SELECT f.company_id, f.scenario_id, b.last_actual AS year, b.b_revenue AS revenue, b.b_ppe_net AS ppe_net, CAST(NULL AS DECIMAL(25,8)) AS capex, CAST(NULL AS DECIMAL(25,8)) AS depreciation"
    " FROM fstatus f JOIN base2 b USING (company_id) WHERE f.state = 'ok' UNION ALL "
    f"SELECT s.company_id, s.scenario_id, d.year, {_rev}, {_c(f's.ppe_net + {_capex} - {_dep} - COALESCE(d.ppe_disposals, 0)')}, {_capex}, {_dep}"
    " FROM fold s JOIN drvw d ON d.company_id = s.company_id AND d.scenario_id = s.scenario_id AND d.year = s.year + 1", "fstatus", "base2", "drvw")
_o = lambda c: f"COALESCE({c}, 0)"
_w = "OVER (PARTITION BY company_id, scenario_id ORDER BY year)"
cte("f1", "SELECT f.*, d.* EXCLUDE (company_id, scenario_id, year), b.* EXCLUDE (company_id, last_actual), "
    + f"COALESCE(d.cogs_amount, {_mul('f.revenue', 'd.cogs_pct_revenue')}) AS cogs, COALESCE(d.opex_amount, {_mul('f.revenue', 'd.opex_pct_revenue')}) AS operating_expenses"
    " FROM fold f JOIN drvw d USING (company_id, scenario_id, year) JOIN base2 b ON b.company_id = f.company_id", "fold", "drvw", "base2")
cte("f2", "SELECT *, " + ", ".join([
    f"{_c('revenue * CAST(dso AS ' + R + ') / 365')} AS accounts_receivable", f"{_c('cogs * CAST(inventory_days AS ' + R + ') / 365')} AS inventory",
    f"{_c('cogs * CAST(dpo AS ' + R + ') / 365')} AS accounts_payable", f"{_mul('revenue', 'other_current_assets_pct_revenue')} AS other_current_assets",
    f"{_mul('revenue', 'other_current_liabilities_pct_revenue')} AS other_current_liabilities", "revenue - cogs - operating_expenses AS ebit",
    f"b_debt + sum({_o('debt_issuance')} - {_o('debt_repayment')}) {_w} AS debt", f"{_mul('revenue', 'COALESCE(sbc_pct_revenue, 0)')} AS sbc"]) + " FROM f1", "f1")
cte("f3", f"SELECT *, accounts_receivable + inventory + other_current_assets - accounts_payable - other_current_liabilities AS nwc,"
    f" {_mul(_c('debt - ' + _o('debt_issuance') + ' + ' + _o('debt_repayment')), 'interest_rate_on_debt')} AS interest_expense FROM f2", "f2")
cte("f4", f"SELECT *, {_c('ebit - interest_expense + ' + _o('other_income_expense'))} AS pretax_income, nwc - COALESCE(lag(nwc) {_w}, b_accounts_receivable + b_inventory + b_other_current_assets - b_accounts_payable - b_other_current_liabilities) AS change_in_nwc FROM f3", "f3")
cte("f5", f"SELECT *, {_mul('pretax_income', 'tax_rate')} AS taxes, {_c('pretax_income - ' + _mul('pretax_income', 'tax_rate'))} AS net_income FROM f4", "f4")
cte("f6", f"SELECT *, COALESCE(dividends_amount, {_mul(_c('greatest(net_income, 0)'), 'COALESCE(dividend_payout_ratio, 0)')}) AS dividends FROM f5", "f5")
cte("f7", f"SELECT *, net_income + depreciation + sbc - change_in_nwc + {_o('other_operating')} AS cfo, -capex - {_o('acquisitions')} + {_o('ppe_disposals')} + {_o('other_investing')} AS cfi,"
    f" {_o('debt_issuance')} - {_o('debt_repayment')} - {_o('share_repurchases')} - dividends + {_o('other_financing')} AS cff FROM f6", "f6")
cte("f8", "SELECT *, " + ", ".join([
    f"b_cash + sum(cfo + cfi + cff) {_w} AS cash", f"b_retained_earnings + sum(net_income - dividends) {_w} AS retained_earnings",
    f"b_common_equity + sum(sbc - {_o('share_repurchases')}) {_w} AS common_equity", f"b_other_noncurrent_assets - sum({_o('other_investing')}) {_w} AS other_noncurrent_assets",
    f"b_other_noncurrent_liabilities + sum({_o('other_operating')} + {_o('other_financing')}) {_w} AS other_noncurrent_liabilities",
    "min(debt) OVER (PARTITION BY company_id, scenario_id) AS lowest_debt"]) + " FROM f7", "f7")
cte("fc", "SELECT *, " + ", ".join([
    f"cash + accounts_receivable + inventory + other_current_assets + ppe_net + {_o('b_goodwill')} + {_o('b_intangibles')} + other_noncurrent_assets AS total_assets",
    f"accounts_payable + other_current_liabilities + debt + {_o('b_lease_liabilities')} + other_noncurrent_liabilities AS total_liabilities",
    f"common_equity + retained_earnings + {_o('b_minority_interest')} AS total_equity",
    f"{_mul(_c('ebit'), '1 - tax_rate')} + depreciation - capex - change_in_nwc AS fcff"]) + " FROM f8 WHERE lowest_debt >= 0", "f8")

FC_COLS = ("revenue", "cogs", "operating_expenses", "ebit", "depreciation", "capex", "ppe_net", "accounts_receivable", "inventory", "accounts_payable",
           "change_in_nwc", "debt", "interest_expense", "pretax_income", "taxes", "net_income", "dividends", "retained_earnings", "common_equity",
           "cfo", "cfi", "cff", "cash", "total_assets", "total_liabilities", "total_equity", "fcff")


@register("forecast_statements", sql(f"SELECT {K}, year, " + ", ".join(sd(c, c, 2) for c in FC_COLS) + " FROM fc", "fc"))
def forecast_statements(spark, sf):
    """F01-F27 in one row per company, scenario and year."""
    return as_double(model(spark, sf).forecast.select("company_id", "scenario_id", "year", *FC_COLS), *FC_COLS, places=2)


@register("f32_scenario_forecast_status", sql(f"SELECT {K}, state FROM fstatus", "fstatus"))
def f32(spark, sf):
    s = model(spark, sf).status
    return s.selectExpr("company_id", "scenario_id", "CASE WHEN may_calculate THEN 'ok' ELSE split(blocked_by, ':')[0] END AS state")


@register("f26_base_balances", sql("SELECT company_id, concat_ws(', ', " + ", ".join(f"CASE WHEN b_{n} IS NULL THEN '{n}' END" for _, n in FC.REQUIRED_BASE) + ") AS missing FROM base2", "base2"))
def f26(spark, sf):
    return FC.opening_balances(full(spark, sf)).select("company_id", F.array_join("missing_base", ", ").alias("missing"))


@register("f29_forecast_periods", sql("SELECT company_id, CAST(max(year) + k.i AS INTEGER) AS year FROM ledger, (SELECT unnest(range(1, 6)) AS i) k GROUP BY company_id, k.i", "ledger"))
def f29(spark, sf):
    return FC.forecast_periods(D.ledger(spark, sf)).select("company_id", "year")


# Companies whose actual years end in 1999, 2000 and 2001, and one in four that did not report 1998.
ENDS, HOLES = "year <= 2001 - company_id % 3", "NOT (company_id % 4 = 1 AND year = 1998)"
_OWN_AXIS = {
    "cy": "SELECT * FROM ({0}) WHERE " + ENDS,
    "fyears": "SELECT company_id, CAST(last + i AS INTEGER) AS year FROM (SELECT company_id, max(year) AS last FROM cy GROUP BY 1), (SELECT unnest(range(1, 6)) AS i)",
}


@register("f29_axis_follows_last_actual", sql(
    f"SELECT f.company_id, f.scenario_id, b.last_actual, f.year, " + sd("f.revenue", "revenue", 2) + ", " + sd("f.fcff", "fcff", 2) + " FROM fc f JOIN base2 b USING (company_id)", "cy", "fyears", "fc", "base2",
    swap=_OWN_AXIS | {
        "resolved": CTES["resolved"][1].replace("JOIN fyears f ON a.period", "JOIN fyears f ON f.company_id = l.company_id AND (a.period").replace("a.period = f.year)", "a.period = f.year))"),
        "gatep": CTES["gatep"][1].replace("FROM scenario s, fyears f, (", "FROM scenario s JOIN fyears f ON f.company_id = s.company_id, ("),
        "fstatus": CTES["fstatus"][1].replace(f"WHEN b.last_actual + 1 <> {D.FORECAST_YEARS[0]} THEN 'periods'", ""),
    }))
def f29_axis(spark, sf):
    """Five years after each company's own last actual one, compounded from there."""
    m = Model(D.ledger(spark, sf, ENDS), D.scenarios(spark, sf), D.assumptions(spark, sf, ENDS), 5)
    return as_double(m.forecast.select("company_id", "scenario_id", "last_actual", "year", "revenue", "fcff"), "revenue", "fcff", places=2)


@register("f32_refused_axis", sql(
    f"SELECT s.company_id, s.scenario_id, CASE WHEN b.last_actual + 1 <> {D.FORECAST_YEARS[0]} THEN 'periods: first forecast year {D.FORECAST_YEARS[0]} does not follow the last actual ' || b.last_actual ELSE s.state END AS reason"
    " FROM fstatus s LEFT JOIN base2 b USING (company_id)", "fstatus", "base2", swap={"cy": _OWN_AXIS["cy"]}))
def f32_refused(spark, sf):
    """One axis for the portfolio: companies that end before it are refused, not compounded over the gap."""
    m = Model(D.ledger(spark, sf, ENDS), D.scenarios(spark, sf), D.assumptions(spark, sf, ENDS), D.FORECAST_YEARS)
    return m.status.selectExpr("company_id", "scenario_id", "CASE WHEN may_calculate THEN 'ok' WHEN blocked_by LIKE 'periods%' THEN blocked_by ELSE split(blocked_by, ':')[0] END AS reason")


@register("p40_period_rules", sql(
    "SELECT company_id, CASE WHEN jumps IS NOT NULL THEN 'historical years are not consecutive: ' || jumps"
    f" WHEN last + 1 <> {D.FORECAST_YEARS[0]} THEN 'first forecast year {D.FORECAST_YEARS[0]} does not follow the last actual ' || last END AS period_problem FROM ("
    "SELECT company_id, max(year) AS last, string_agg(CASE WHEN year <> p + 1 THEN p || ' -> ' || year END, ', ' ORDER BY year) AS jumps FROM ("
    "SELECT company_id, year, lag(year) OVER (PARTITION BY company_id ORDER BY year) AS p FROM cy) GROUP BY company_id)", "cy", swap={"cy": "SELECT * FROM ({0}) WHERE " + ENDS + " AND " + HOLES}))
def p40(spark, sf):
    return PD.company_axis(L.to_wide(D.ledger(spark, sf, ENDS + " AND " + HOLES)), D.FORECAST_YEARS).select("company_id", "period_problem")


@register("f28_basis_strings", sql("SELECT statement, account, CAST(count(*) AS BIGINT) AS cells, CAST(0 AS BIGINT) AS without_basis FROM (SELECT s.statement, s.account, f.company_id FROM fc f, ("
    + values([(s, a) for s, a, *_ in FC.LINES], "statement, account", "s") + ") s WHERE NOT (s.account = 'goodwill' AND f.b_goodwill IS NULL) AND NOT (s.account = 'intangibles' AND f.b_intangibles IS NULL)"
    " AND NOT (s.account = 'lease_liabilities' AND f.b_lease_liabilities IS NULL) AND NOT (s.account = 'minority_interest' AND f.b_minority_interest IS NULL)) GROUP BY 1, 2", "fc"))
def f28(spark, sf):
    return FC.to_long(model(spark, sf).forecast).groupBy("statement", "account").agg(F.count("*").alias("cells"), F.count_if(F.expr("basis IS NULL OR trim(basis) = ''")).alias("without_basis"))


# A forecast in which someone typed over a figure of one year, for every second company.
_TYPED = "company_id % 2 = 0 AND account = 'capex' AND year = 2004"


@register("c07_forecast_origins", sql("SELECT company_id, scenario_id, CASE WHEN company_id % 2 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(max(CASE WHEN company_id % 2 = 0 AND year = 2004 THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM fc GROUP BY 1, 2", "fc"))
def c07(spark, sf):
    """Cells of forecast years by their origin: a typed figure is found whatever its basis text says."""
    rows = FC.to_long(model(spark, sf).forecast).withColumn("origin", F.expr(f"CASE WHEN {_TYPED} THEN 'reported' ELSE origin END"))
    return C.hardcode_check(rows).select("company_id", "scenario_id", "status", "broken")


@register("f30_tax_basis", sql(f"SELECT {K}, year, " + sd("tax_rate", "tax_rate", 6) + ", CASE WHEN tax_source_type = 'Historical Driver' THEN 'historical_effective' WHEN tax_source_type IN ('Company Filing', 'Company Guidance') THEN 'statutory' ELSE 'normalized_effective' END AS basis FROM fc", "fc"))
def f30(spark, sf):
    return as_double(model(spark, sf).forecast.selectExpr("company_id", "scenario_id", "year", "tax_rate", "tax_basis AS basis"), "tax_rate", places=6)


@register("f33_driver_table", sql(f"SELECT {K}, year, code, unit, " + sd("value", "value", 6) + f" FROM resolved WHERE status NOT IN {_BLOCK} AND code IN ({', '.join(q(d[0]) for d in dims.DRIVERS if d[0] != 'tax_rate')})", "resolved"))
def f33(spark, sf):
    dim = F.broadcast(dims.driver_df(spark).select("code", "driver_order"))
    r = S.usable(model(spark, sf).resolved).where("code <> 'tax_rate'").join(dim, "code")
    return as_double(r.select("company_id", "scenario_id", "year", "code", "unit", "value"), "value", places=6)


_COMPARED = ("revenue", "ebit", "net_income", "fcff")


@register("j19_scenario_comparison", sql(
    f"SELECT s.company_id, s.scenario_id, " + ", ".join(sd(f"max(CASE WHEN f.year = {y} THEN f.{c} END)", f"{c}_{y}", 2) for c in _COMPARED for y in D.FORECAST_YEARS)
    + ", COALESCE((SELECT string_agg(DISTINCT d.code, ', ' ORDER BY d.code) FROM diffs d WHERE d.company_id = s.company_id AND d.scenario_id = s.scenario_id), '') AS differs_in FROM scenario s LEFT JOIN fc f USING (company_id, scenario_id) GROUP BY s.company_id, s.scenario_id", "fc", "scenario", "diffs"))
def j19(spark, sf):
    m = model(spark, sf)
    c = S.comparison(m.scenarios, m.assumptions, m.forecast, D.FORECAST_YEARS, _COMPARED)
    return c.select("company_id", "scenario_id", *[dbl(f"{n}_{y}", 2).alias(f"{n}_{y}") for n in _COMPARED for y in D.FORECAST_YEARS], "differs_in")


@register("s22_revenue_series", sql(
    "SELECT company_id, 'base' AS scenario_id, year, 'reported' AS basis, " + sd("value", "revenue", 2) + " FROM ledger WHERE account = 'revenue' UNION ALL SELECT company_id, scenario_id, year, 'forecast', "
    + sd("revenue", "revenue", 2) + " FROM fc WHERE scenario_id = 'base'", "ledger", "fc"))
def s22(spark, sf):
    m = model(spark, sf)
    a = m.ledger.where("account = 'revenue'").selectExpr("company_id", "'base' AS scenario_id", "year", "'reported' AS basis", "value AS revenue")
    f = m.forecast.where("scenario_id = 'base'").selectExpr("company_id", "scenario_id", "year", "'forecast' AS basis", "revenue")
    return as_double(a.unionByName(f).orderBy("company_id", "year"), "revenue", places=2)


_SEG = "SELECT l_suppkey AS company_id, l_returnflag AS segment, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(25,8)) AS base_revenue FROM lineitem JOIN (SELECT l_suppkey AS k, max(year(l_shipdate)) AS last FROM lineitem GROUP BY 1) m ON m.k = l_suppkey AND m.last = year(l_shipdate) GROUP BY 1, 2"
cte("segfold", "SELECT company_id, segment, 2001 AS year, base_revenue AS revenue FROM (" + _SEG + ") UNION ALL SELECT company_id, segment, year + 1, CAST(revenue * CAST(1 + CASE segment WHEN 'A' THEN 0.03 WHEN 'N' THEN 0.06 ELSE -0.01 END AS DECIMAL(12,8)) AS DECIMAL(25,8)) FROM segfold WHERE year < 2006")


@register("a05_segment_rollup", sql("SELECT company_id, year, " + sd("sum(revenue)", "revenue") + ", CAST(count(*) AS BIGINT) AS segments FROM segfold WHERE year > 2001 GROUP BY 1, 2", "segfold"))
def a05(spark, sf):
    li = D.table(spark, sf, "lineitem").selectExpr("l_suppkey AS company_id", "year(l_shipdate) AS year", "l_returnflag AS segment", "CAST(l_extendedprice AS DECIMAL(12,2)) AS px")
    by_year = li.groupBy("company_id", "segment", "year").agg(F.sum("px").cast("decimal(25,8)").alias("base_revenue"))
    seg = by_year.selectExpr("*", "max(year) OVER (PARTITION BY company_id) AS last").where("year = last").drop("year", "last")
    g = seg.selectExpr("company_id", "'base' AS scenario_id", "segment", f"explode({S.years_array(D.FORECAST_YEARS)}) AS year",
                       "CAST(CASE segment WHEN 'A' THEN 0.03 WHEN 'N' THEN 0.06 ELSE -0.01 END AS DECIMAL(12,8)) AS rate")
    return as_double(FC.segment_revenue(seg, g).drop("scenario_id"), "revenue")


@register("p42_actual_estimate", sql("SELECT DISTINCT company_id, CAST(year AS VARCHAR) || 'A' AS label, 'actual' AS kind FROM ledger UNION ALL SELECT DISTINCT company_id, CAST(year AS VARCHAR) || 'E', 'estimate' FROM fc", "ledger", "fc"))
def p42(spark, sf):
    m = model(spark, sf)
    labels = m.ledger.selectExpr("company_id", "concat(year, 'A') AS label").distinct().unionByName(m.forecast.selectExpr("company_id", "concat(year, 'E') AS label").distinct())
    return labels.withColumn("kind", F.when(F.substring("label", -1, 1) == "A", "actual").otherwise("estimate"))


# ---- valuation --------------------------------------------------------------------------------
_BR = [c for c, _, _, g in dims.MARKET_INPUTS if g == "bridge" and c != "diluted_shares"]
cte("market", f"SELECT {K}, " + ", ".join(f"max(CASE WHEN code = '{c}' AND status NOT IN {_BLOCK} THEN value END) AS m_{c}" for c, *_ in dims.MARKET_INPUTS)
    + f" FROM anyres WHERE code IN ({', '.join(q(c) for c, *_ in dims.MARKET_INPUTS)}) GROUP BY {K}", "anyres")
cte("coc",
    "SELECT *, CAST(we * ke + wd * kd AS DOUBLE) AS wacc FROM (SELECT l.company_id, l.scenario_id, l.tax_rate, m.* EXCLUDE (company_id, scenario_id),"
    " CAST(m_risk_free_rate AS DOUBLE) + CAST(m_beta AS DOUBLE) * CAST(m_equity_risk_premium AS DOUBLE) AS ke, CAST(m_pretax_cost_of_debt AS DOUBLE) * (1 - CAST(tax_rate AS DOUBLE)) AS kd,"
    " CAST(m_market_value_equity AS DOUBLE) / CAST(m_market_value_equity + m_market_value_debt AS DOUBLE) AS we, CAST(m_market_value_debt AS DOUBLE) / CAST(m_market_value_equity + m_market_value_debt AS DOUBLE) AS wd"
    f" FROM (SELECT {K}, arg_max(tax_rate, year) AS tax_rate FROM fc GROUP BY {K}) l JOIN market m USING (company_id, scenario_id))", "fc", "market")


def dcf_cte(name: str, t: str) -> None:
    cte(f"dy{name}", "SELECT *, CAST(fcff AS DOUBLE) * df AS pv FROM (SELECT *, pow(1 + wacc, -t) AS df FROM (SELECT f.company_id, f.scenario_id, f.year, f.fcff, f.b_cash, f.b_debt, c.* EXCLUDE (company_id, scenario_id, tax_rate), "
        + t + " AS t FROM (SELECT *, row_number() OVER (PARTITION BY company_id, scenario_id ORDER BY year) AS n FROM fc) f JOIN coc c USING (company_id, scenario_id)))", "fc", "coc")
    cte(f"val{name}",
        "SELECT *, pv_explicit + pv_terminal AS ev, pv_explicit + pv_terminal + CAST(b_cash - b_debt + " + " ".join(("" if c == _BR[0] else "- ") + f"COALESCE(m_{c}, 0)" for c in _BR) + " AS DOUBLE) AS equity FROM ("
        "SELECT *, tv * last_df AS pv_terminal FROM (SELECT *, CASE WHEN wacc > g THEN last_fcff * (1 + g) / (wacc - g) END AS tv FROM ("
        "SELECT company_id, scenario_id, any_value(wacc) AS wacc, any_value(ke) AS ke, any_value(kd) AS kd, any_value(we) AS we, any_value(CAST(m_terminal_growth AS DOUBLE)) AS g, sum(pv) AS pv_explicit, arg_max(CAST(fcff AS DOUBLE), year) AS last_fcff, arg_max(df, year) AS last_df,"
        " any_value(b_cash) AS b_cash, any_value(b_debt) AS b_debt, " + ", ".join(f"any_value(m_{c}) AS m_{c}" for c in _BR + ["diluted_shares"]) + f" FROM dy{name} GROUP BY company_id, scenario_id)))", f"dy{name}")


dcf_cte("ye", "CAST(n AS DOUBLE)")
dcf_cte("my", "n - CAST(0.5 AS DOUBLE)")
dcf_cte("ex", "date_diff('day', DATE '2001-06-30', make_date(year, 12, 31)) / CAST(365 AS DOUBLE)")


@register("v01_fcff", sql(f"SELECT {K}, year, " + ", ".join(sd(c, c, 2) for c in ("ebit", "depreciation", "capex", "change_in_nwc", "fcff")) + " FROM fc", "fc"))
def v01(spark, sf):
    return as_double(model(spark, sf).forecast.select("company_id", "scenario_id", "year", "ebit", "depreciation", "capex", "change_in_nwc", "fcff"), "ebit", "depreciation", "capex", "change_in_nwc", "fcff", places=2)


@register("v04_cost_of_capital", sql(f"SELECT {K}, " + sd("ke", "cost_of_equity", 6) + ", " + sd("kd", "after_tax_debt", 6) + ", " + sd("we", "weight_equity", 6) + ", " + sd("wd", "weight_debt", 6) + ", " + sd("wacc", "wacc", 6) + " FROM coc", "coc"))
def v04(spark, sf):
    return as_double(model(spark, sf).cost_of_capital.select("company_id", "scenario_id", "cost_of_equity", "after_tax_debt", "weight_equity", "weight_debt", "wacc"), "cost_of_equity", "after_tax_debt", "weight_equity", "weight_debt", "wacc", places=6)


def _dcf_years_query(conv, **kw):
    def run(spark, sf):
        d = model(spark, sf).dcf_years(conv, **kw)
        return d.select("company_id", "scenario_id", "year", dbl("t", 6).alias("t"), dbl("discount_factor", 6).alias("discount_factor"), dbl("present_value", 2).alias("present_value"))
    return run


for _n, _s, _conv, _kw in (("v06_dcf_year_end", "ye", "year_end", {}), ("v05_dcf_mid_year", "my", "mid_year", {}), ("v05_dcf_exact_date", "ex", "exact_date", {"valuation_date": "2001-06-30"})):
    register(_n, sql(f"SELECT {K}, year, " + sd("t", "t", 6) + ", " + sd("df", "discount_factor", 6) + ", " + sd("pv", "present_value", 2) + f" FROM dy{_s}", f"dy{_s}"))(_dcf_years_query(_conv, **_kw))

VAL_SQL = (f"SELECT {K}, " + ", ".join(sd(e, n, p) for e, n, p in (("wacc", "wacc", 6), ("pv_explicit", "pv_explicit", 2), ("tv", "terminal_value", 2), ("pv_terminal", "pv_terminal", 2), ("ev", "enterprise_value", 2), ("equity", "equity_value", 2),
           ("equity / CAST(m_diluted_shares AS DOUBLE)", "per_share", 4), ("pv_terminal / ev", "terminal_share", 6))) + ", COALESCE(pv_terminal / ev > 0.75, FALSE) AS terminal_warning,"
           " CASE WHEN wacc - g <= 0 THEN 'blocked' WHEN wacc - g < 0.02 THEN 'narrow' WHEN g IS NOT NULL THEN 'ok' END AS headroom_state FROM val{0}")


def _valuation(conv):
    def run(spark, sf):
        v = V.value(model(spark, sf).dcf_years(conv))
        return v.select("company_id", "scenario_id", dbl("wacc", 6).alias("wacc"), *[dbl(c, 2).alias(c) for c in ("pv_explicit", "terminal_value", "pv_terminal", "enterprise_value", "equity_value")],
                        dbl("per_share", 4).alias("per_share"), dbl("terminal_share", 6).alias("terminal_share"), "terminal_warning", "headroom_state")
    return run


register("v12_scenario_valuation", sql(VAL_SQL.replace("{0}", "ye"), "valye"))(_valuation("year_end"))
register("v12_scenario_valuation_mid_year", sql(VAL_SQL.replace("{0}", "my"), "valmy"))(_valuation("mid_year"))


@register("j28_missing_market_inputs", sql(
    "SELECT s.company_id, s.scenario_id, concat_ws(', ', " + ", ".join(f"CASE WHEN m.m_{c} IS NULL THEN '{c}' END" for c in sorted(c for c, _, r, _ in dims.MARKET_INPUTS if r)) + ") AS missing FROM scenario s LEFT JOIN market m USING (company_id, scenario_id)", "scenario", "market"))
def j28(spark, sf):
    return model(spark, sf).status.select("company_id", "scenario_id", F.array_join("missing_inputs", ", ").alias("missing"))


@register("v09_equity_bridge", sql(" UNION ALL ".join(
    f"SELECT {K}, '{n}' AS line, {sd(e, 'amount', 2)} FROM valye WHERE ev IS NOT NULL" for n, e in
    [("enterprise_value", "ev"), ("cash", "b_cash"), ("debt", "-b_debt"), ("non_operating_investments", "COALESCE(m_non_operating_investments, 0)")]
    + [(c, f"-COALESCE(m_{c}, 0)") for c in _BR[1:]] + [("equity_value", "equity")]), "valye"))
def v09(spark, sf):
    return as_double(V.bridge_lines(model(spark, sf).valuation).drop("ordinal"), "amount", places=2)


@register("v17_flow_rows", sql(f"SELECT d.company_id, d.scenario_id, d.year, " + ", ".join(sd(f"f.{c}", c, 2) for c in ("ebit", "depreciation", "capex", "change_in_nwc", "fcff")) + ", " + sd("d.pv", "present_value", 2) + " FROM dyye d JOIN fc f USING (company_id, scenario_id, year)", "dyye"))
def v17(spark, sf):
    cols = ("ebit", "depreciation", "capex", "change_in_nwc", "fcff", "present_value")
    return as_double(model(spark, sf).dcf_years().select("company_id", "scenario_id", "year", *cols), *cols, places=2)


WACC_AXIS, GROWTH_AXIS = ("0.08", "0.09", "0.10"), ("0.02", "0.03", "0.09")
_CLAIMS = "CAST(b_cash - b_debt + COALESCE(m_non_operating_investments, 0) - " + " - ".join(f"COALESCE(m_{c}, 0)" for c in _BR[1:]) + " AS DOUBLE)"
_GRID = ("SELECT company_id, scenario_id, w AS wacc, g AS terminal_growth, CASE WHEN w <= g THEN 'n/a: WACC <= g' END AS note, CASE WHEN w > g THEN sum(CAST(fcff AS DOUBLE) * pow(1 + w, -n)) + arg_max(CAST(fcff AS DOUBLE), n) * (1 + g) / (w - g) * pow(1 + w, -max(n)) END AS ev,"
         " any_value(" + _CLAIMS + ") AS claims FROM ")
cte("grid", _GRID + "(SELECT *, row_number() OVER (PARTITION BY company_id, scenario_id ORDER BY year) AS n FROM dyye), (SELECT CAST(unnest([0.08, 0.09, 0.10]) AS DOUBLE) AS w), (SELECT CAST(unnest([0.02, 0.03, 0.09]) AS DOUBLE) AS g) GROUP BY 1, 2, 3, 4", "dyye")


cte("gridmy", "SELECT company_id, scenario_id, w AS wacc, g AS terminal_growth, CASE WHEN w <= g THEN 'n/a: WACC <= g' END AS note, CASE WHEN w > g THEN sum(CAST(fcff AS DOUBLE) * pow(1 + w, -t)) + arg_max(CAST(fcff AS DOUBLE), t) * (1 + g) / (w - g) * pow(1 + w, -max(t)) END AS ev"
    " FROM dymy, (SELECT CAST(unnest([0.08, 0.09, 0.10]) AS DOUBLE) AS w), (SELECT CAST(unnest([0.02, 0.03, 0.09]) AS DOUBLE) AS g) GROUP BY 1, 2, 3, 4", "dymy")


@register("v13_sensitivity", sql(f"SELECT {K}, " + sd("wacc", "wacc", 6) + ", " + sd("terminal_growth", "terminal_growth", 6) + ", note, " + sd("ev", "enterprise_value", 1) + ", " + sd("ev + claims", "equity_value", 1) + " FROM grid", "grid"))
def v13(spark, sf):
    c = V.sensitivity(model(spark, sf).dcf_years(), WACC_AXIS, GROWTH_AXIS)
    return c.select("company_id", "scenario_id", dbl("wacc", 6).alias("wacc"), dbl("terminal_growth", 6).alias("terminal_growth"), "note", dbl("enterprise_value", 1).alias("enterprise_value"), dbl("equity_value", 1).alias("equity_value"))


@register("v14_centred_grid", sql(
    "SELECT company_id, scenario_id, " + sd("w", "wacc", 6) + ", " + sd("g", "terminal_growth", 6) + ", " + sd("CASE WHEN w > g THEN sum(CAST(fcff AS DOUBLE) * pow(1 + w, -n)) + arg_max(CAST(fcff AS DOUBLE), n) * (1 + g) / (w - g) * pow(1 + w, -max(n)) END", "enterprise_value", 3)
    + " FROM (SELECT *, wacc + i * 0.0025 AS w, CAST(m_terminal_growth AS DOUBLE) + j * 0.0025 AS g, row_number() OVER (PARTITION BY company_id, scenario_id, i, j ORDER BY year) AS n FROM dyye, (SELECT CAST(unnest(range(-2, 3)) AS DOUBLE) AS i), (SELECT CAST(unnest(range(-2, 3)) AS DOUBLE) AS j) WHERE m_terminal_growth IS NOT NULL)"
    " GROUP BY company_id, scenario_id, w, g", "dyye"))
def v14(spark, sf):
    c = V.centred_grid(model(spark, sf).dcf_years())
    return c.select("company_id", "scenario_id", dbl("wacc", 6).alias("wacc"), dbl("terminal_growth", 6).alias("terminal_growth"), dbl("enterprise_value", 3).alias("enterprise_value"))


@register("v13_sensitivity_mid_year", sql(f"SELECT {K}, " + sd("wacc", "wacc", 6) + ", " + sd("terminal_growth", "terminal_growth", 6) + ", note, " + sd("ev", "enterprise_value", 1) + " FROM gridmy", "gridmy"))
def v13_mid_year(spark, sf):
    c = V.sensitivity(model(spark, sf).dcf_years("mid_year"), WACC_AXIS, GROWTH_AXIS)
    return c.select("company_id", "scenario_id", dbl("wacc", 6).alias("wacc"), dbl("terminal_growth", 6).alias("terminal_growth"), "note", dbl("enterprise_value", 1).alias("enterprise_value"))


@register("v14_centred_grid_exact_date", sql(
    "SELECT company_id, scenario_id, " + sd("w", "wacc", 6) + ", " + sd("g", "terminal_growth", 6) + ", " + sd("CASE WHEN w > g THEN sum(CAST(fcff AS DOUBLE) * pow(1 + w, -t)) + arg_max(CAST(fcff AS DOUBLE), t) * (1 + g) / (w - g) * pow(1 + w, -max(t)) END", "enterprise_value", 1)
    + " FROM (SELECT *, wacc + i * 0.0025 AS w, CAST(m_terminal_growth AS DOUBLE) + j * 0.0025 AS g FROM dyex, (SELECT CAST(unnest(range(-2, 3)) AS DOUBLE) AS i), (SELECT CAST(unnest(range(-2, 3)) AS DOUBLE) AS j) WHERE m_terminal_growth IS NOT NULL)"
    " GROUP BY company_id, scenario_id, w, g", "dyex"))
def v14_exact_date(spark, sf):
    c = V.centred_grid(model(spark, sf).dcf_years("exact_date", valuation_date="2001-06-30"))
    return c.select("company_id", "scenario_id", dbl("wacc", 6).alias("wacc"), dbl("terminal_growth", 6).alias("terminal_growth"), dbl("enterprise_value", 1).alias("enterprise_value"))


@register("v05_refused_dates", sql(f"SELECT {K}, CASE WHEN min(year) < 2003 THEN 'cash flow before the valuation date' END AS blocked_by FROM fc GROUP BY {K}", "fc"))
def v05_refused(spark, sf):
    """A valuation date behind the first flow compounds it instead of discounting: the scenario is refused."""
    v = V.value(model(spark, sf).dcf_years("exact_date", valuation_date="2003-06-30"))
    return v.select("company_id", "scenario_id", F.when(F.col("blocked_by").contains("before the valuation date"), "cash flow before the valuation date").alias("blocked_by"))


@register("e10_sensitivity_table", sql(f"SELECT {K}, " + sd("wacc", "wacc", 6) + ", " + ", ".join(sd(f"max(CASE WHEN terminal_growth = {g} THEN ev END)", f"g_{g[2:]}", 1) for g in GROWTH_AXIS) + f" FROM grid GROUP BY {K}, wacc", "grid"))
def e10(spark, sf):
    c = V.sensitivity(model(spark, sf).dcf_years(), WACC_AXIS, GROWTH_AXIS).withColumn("terminal_growth", F.col("terminal_growth").cast("decimal(4,2)").cast("string"))
    t = V.grid_table(c, GROWTH_AXIS)
    return t.select("company_id", "scenario_id", dbl("wacc", 6).alias("wacc"), *[dbl(F.col(f"`{g}`"), 1).alias(f"g_{g[2:]}") for g in GROWTH_AXIS])


# ---- checks -----------------------------------------------------------------------------------
def _hist_check(name: str, left: str, right: str, cond: str = "TRUE", src: str = "prevd") -> str:
    return (f"SELECT company_id, '{name}' AS check_name, CASE WHEN count(*) FILTER (WHERE {cond} AND ({left}) - ({right}) IS NOT NULL) = 0 THEN 'SKIP' WHEN count(*) FILTER (WHERE {cond} AND NOT ({close_sql(left, right)})) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM {src} GROUP BY company_id")


_FLOW = "cf_cash_flow_from_operations + cf_cash_flow_from_investing + cf_cash_flow_from_financing"
_HIST = " UNION ALL ".join([
    _hist_check("historical balance sheet balances", "bs_total_assets", "(bs_total_liabilities + bs_total_equity)"),
    _hist_check("historical cash flow reconciles", f"(prev_bs_cash + {_FLOW})", "bs_cash", "n > 1"),
    _hist_check("net income linkage", "is_net_income", "cf_net_income"),
])


def _from_filled(t: str) -> str:
    """A subtotal from the filled columns, beside the reported one."""
    return f"SELECT w.company_id, w.{_PREFIX[dims.DERIVATIONS[t][0]]}{t} AS reported, d.derived FROM wide w JOIN (SELECT company_id, year, {_drv(t)} AS derived FROM derived) d USING (company_id, year)"


cte("drvf", " UNION ALL ".join(_from_filled(t) for t in dims.DERIVATIONS), "wide", "derived")


@register("l16_historical_check_set", sql(_HIST + " UNION ALL SELECT company_id, 'reported subtotals reconcile', CASE WHEN count(reported - derived) = 0 THEN 'SKIP' WHEN count(*) FILTER (WHERE NOT " + close_sql("reported", "derived", "'0.000001'") + ") > 0 THEN 'FAIL' ELSE 'PASS' END FROM drvf GROUP BY company_id", "prevd", "drvf"))
def l16(spark, sf):
    r = C.historical_checks(L.fill_with_reported(L.to_wide(D.ledger(spark, sf))))
    return r.select("company_id", "check_name", "status")


@register("c03_reported_subtotals", sql(
    "SELECT company_id, CASE WHEN count(reported - derived) = 0 THEN 'SKIP' WHEN count(*) FILTER (WHERE NOT " + close_sql("reported", "derived", "'0.000001'") + ") > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM drvf GROUP BY company_id", "drvf"))
def c03(spark, sf):
    r = C.historical_checks(L.fill_with_reported(L.to_wide(D.ledger(spark, sf))))
    return r.where("check_name = 'reported subtotals reconcile'").select("company_id", "status")


def _fore(name, left, right, cond="TRUE"):
    return f"SELECT company_id, scenario_id, '{name}' AS check_name, CASE WHEN count(*) FILTER (WHERE {cond} AND NOT ({close_sql(left, right)})) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM fcp GROUP BY 1, 2"


cte("fcp", "SELECT *, COALESCE(lag(cash) OVER w, b_cash) AS pc, COALESCE(lag(ppe_net) OVER w, b_ppe_net) AS pp, COALESCE(lag(debt) OVER w, b_debt) AS pd, COALESCE(lag(retained_earnings) OVER w, b_retained_earnings) AS pr FROM fc WINDOW w AS (PARTITION BY company_id, scenario_id ORDER BY year)", "fc")
cte("okscen", "SELECT company_id, scenario_id FROM fstatus WHERE state = 'ok'", "fstatus")


_PANEL_SQL = (
    " UNION ALL ".join([
        _fore("forecast balance sheet balances", "total_assets", "(total_liabilities + total_equity)"),
        _fore("PP&E schedule linkage", "(pp + capex - depreciation)", "ppe_net"),
        _fore("debt schedule linkage", f"(pd + {_o('debt_issuance')} - {_o('debt_repayment')})", "debt"),
        _fore("retained earnings linkage", "(pr + net_income - dividends)", "retained_earnings"),
        _fore("ending cash linkage", "(pc + cfo + cfi + cff)", "cash"),
        _fore("FCFF matches the statements", "fcff", f"(ebit - CAST(ebit * CAST(tax_rate AS DECIMAL(12,8)) AS {M}) + depreciation - capex - change_in_nwc)"),
        "SELECT company_id, scenario_id, 'no forecast hardcodes' AS check_name, 'PASS' AS status FROM fc GROUP BY 1, 2",
        "SELECT company_id, scenario_id, 'forecast cash flow subtotals' AS check_name, 'PASS' AS status FROM fc GROUP BY 1, 2",
        "SELECT company_id, scenario_id, 'WACC above terminal growth' AS check_name, CASE WHEN g IS NULL THEN 'SKIP' WHEN wacc > g THEN 'PASS' ELSE 'FAIL' END AS status FROM valye",
        f"SELECT o.company_id, o.scenario_id, h.check_name, h.status FROM okscen o JOIN ({_HIST.replace(_hist_check('net income linkage', 'is_net_income', 'cf_net_income'), 'SELECT company_id, ' + chr(39) + 'x' + chr(39) + ', ' + chr(39) + 'x' + chr(39) + ' FROM prevd WHERE FALSE')}) h USING (company_id)",
        f"SELECT o.company_id, o.scenario_id, 'net income linkage', CASE WHEN max(CASE WHEN NOT ({close_sql('is_net_income', 'cf_net_income')}) THEN 1 ELSE 0 END) > 0 THEN 'FAIL' ELSE 'PASS' END FROM okscen o JOIN prevd p USING (company_id) GROUP BY 1, 2",
    ])
)
_SUBTOTALS = ("SELECT company_id, 'reported subtotals reconcile' AS check_name, CASE WHEN count(reported - derived) = 0 THEN 'SKIP' WHEN count(*) FILTER (WHERE NOT "
              + close_sql("reported", "derived", "'0.000001'") + ") > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM drvf GROUP BY company_id")
_PANEL_SQL += f" UNION ALL SELECT o.company_id, o.scenario_id, h.check_name, h.status FROM okscen o JOIN ({_SUBTOTALS}) h USING (company_id)"
_PANEL_NEEDS = ("fcp", "valye", "prevd", "okscen", "drvf")


@register("u03_all_checks", sql(_PANEL_SQL, *_PANEL_NEEDS))
def u03(spark, sf):
    return model(spark, sf).checks.select("company_id", "scenario_id", "check_name", "status")


@register("a12_check_summary", sql(
    "SELECT scenario_id, check_name, " + ", ".join(f"CAST(count(*) FILTER (WHERE status = '{x}') AS BIGINT) AS {x.lower()}" for x in ("PASS", "FAIL", "SKIP"))
    + f" FROM ({_PANEL_SQL}) GROUP BY ROLLUP (scenario_id, check_name)", *_PANEL_NEEDS))
def a12(spark, sf):
    return C.counts(model(spark, sf).checks, "scenario_id", "check_name")
