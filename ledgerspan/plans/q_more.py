"""Registered queries: presentation, exports, fingerprints, metrics, portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims, money
from ..operators import audit as AU
from ..operators import exports as EX
from ..operators import forecast as FC
from ..operators import impact as IM
from ..operators import ledger as L
from ..operators import metrics as X
from ..operators import portfolio as PF
from ..sources import derived as D
from ..sources import filings as FL
from ..sources import readers as R
from ..sources import writers as WR
from . import q_filing  # noqa: F401  (its common table expressions)
from .duck import M, q, sql, values
from .q_ledger import _drv, full
from .q_model import model
from .registry import as_double, dbl, register, sd


@register("p25_unit_multiplier", "SELECT nation, CAST(count(*) AS BIGINT) AS companies, CAST(sum(s_acctbal_c * mult) AS DOUBLE) AS total FROM (SELECT s_nationkey AS nation, CAST(s_acctbal AS DECIMAL(12,2)) AS s_acctbal_c, CASE s_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS mult FROM supplier) GROUP BY nation")
def p25(spark, sf):
    s = D.table(spark, sf, "supplier").withColumn("units", F.element_at(F.array(F.lit("dollars"), F.lit("thousands"), F.lit("millions")), F.col("s_nationkey") % 3 + 1))
    return s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("companies"), F.sum(F.col("s_acctbal").cast("decimal(12,2)") * money.unit_multiplier(F.col("units"))).cast("double").alias("total"))


@register("p27_relative_error", sql("SELECT company_id, year, account, " + sd("CAST(abs(reported - derived) / nullif(abs(derived), 0) * 100 AS DECIMAL(20,8))", "relative_error_pct", 6) + " FROM drv WHERE reported IS NOT NULL AND derived IS NOT NULL", "drv"))
def p27(spark, sf):
    c = L.cross_check(L.to_wide(D.ledger(spark, sf)))
    return as_double(c.select("company_id", "year", "account", "relative_error_pct"), "relative_error_pct", places=6)


@register("p28_display_round", sql("SELECT company_id, statement, account, year, CAST(round_even(value, 0) AS DOUBLE) AS shown, round_even(value, 0) <> value AS is_rounded FROM ledger", "ledger"))
def p28(spark, sf):
    """Printed whole, read back, and flagged where printing loses something."""
    d = D.ledger(spark, sf).withColumn("text", money.display(F.col("value"), 0))
    return d.select("company_id", "statement", "account", "year", F.translate("text", ",", "").cast("double").alias("shown"), money.is_rounded(F.col("value"), 0).alias("is_rounded"))


@register("p26_close", sql("SELECT company_id, year, abs(v - p) <= greatest(abs(v), abs(p)) * 0.1 AS within FROM (SELECT company_id, year, value AS v, lag(value) OVER (PARTITION BY company_id ORDER BY year) AS p FROM ledger WHERE account = 'revenue') WHERE p IS NOT NULL", "ledger"))
def p26(spark, sf):
    r = D.ledger(spark, sf).where("account = 'revenue'").withColumn("p", F.lag("value").over(L.by_year())).where("p IS NOT NULL")
    return r.select("company_id", "year", money.close(F.col("value"), F.col("p"), rel="0.1").alias("within"))


@register("s05_required_fields", "SELECT event_id, field FROM (SELECT event_id, unnest([CASE WHEN event_type = 'error' THEN 'value' END, CASE WHEN user_id % 5 = 0 THEN 'actor' END]) AS field FROM events) WHERE field IS NOT NULL")
def s05(spark, sf):
    e = D.table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_type <> 'error' THEN value END AS value", "CASE WHEN user_id % 5 = 0 THEN '  ' ELSE 'u' END AS actor")
    return R.required_fields(e, ["value", "actor"], "event_id")


@register("s11_dedupe_by_hash", "SELECT CAST(page_id % 10 AS INTEGER) AS company_id, CAST(count(*) AS BIGINT) AS files, CAST(count(*) - count(DISTINCT sha256(html)) AS BIGINT) AS refused FROM (SELECT page_id, html FROM pages UNION ALL SELECT page_id, html FROM pages WHERE page_id % 3 = 0) GROUP BY 1")
def s11(spark, sf):
    p = D.table(spark, sf, "pages").selectExpr("CAST(page_id % 10 AS INT) AS company_id", "page_id AS file_id", "sha2(html, 256) AS hash", "1 AS uploaded_at", "CAST(NULL AS STRING) AS link_reason")
    again = p.where("file_id % 3 = 0").selectExpr("company_id", "-file_id - 1 AS file_id", "hash", "2 AS uploaded_at", "link_reason")
    empty = p.where("1 = 0").select("company_id", "hash")
    d = R.dedupe_by_hash(p.unionByName(again), empty)
    return d.groupBy("company_id").agg(F.count("*").alias("files"), F.count("refusal").alias("refused"))


@register("s12_verify_hashes", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'mismatch' WHEN page_id % 11 = 0 THEN 'missing' ELSE 'match' END AS state FROM pages")
def s12(spark, sf):
    p = D.table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("hash"))
    found = p.where("page_id % 11 <> 0 OR page_id % 7 = 0").withColumn("hash", F.when(F.col("page_id") % 7 == 0, F.reverse("hash")).otherwise(F.col("hash")))
    return R.verify_hashes(found, p, "page_id").select("page_id", "state")


@register("s16_export_csv", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '''=' || p_name WHEN p_size % 5 = 1 THEN '''@' || p_name ELSE p_name END AS name FROM part")
def s16(spark, sf):
    p = D.table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_size % 5 = 0 THEN concat('=', p_name) WHEN p_size % 5 = 1 THEN concat('@', p_name) ELSE p_name END AS name")
    return WR.neutralised(p)


@register("s18_neutralized_report", "SELECT p_partkey, 'name' AS column, '-' || p_name AS text FROM part WHERE p_size % 5 = 0")
def s18(spark, sf):
    p = D.table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS p_partkey", "CASE WHEN p_size % 5 = 0 THEN concat('-', p_name) ELSE p_name END AS name", "p_brand AS brand")
    return WR.neutralised_cells(p, "p_partkey").withColumn("p_partkey", F.col("p_partkey").cast("long"))


@register("s19_export_json", sql("SELECT company_id, account, year, CAST(value AS VARCHAR) AS value, FALSE AS absent FROM ledger", "ledger"))
def s19(spark, sf):
    j = WR.json_cells(D.ledger(spark, sf).withColumn("note", F.lit("")), ["company_id", "account", "year", "statement"], "value", "note")
    c = F.from_json("cell", "value STRING, absent BOOLEAN")
    return j.select("company_id", "account", "year", c["value"].alias("value"), c["absent"].alias("absent"))


@register("s23_round_trip_double", "SELECT CAST(count(*) AS BIGINT) AS cells, CAST(0 AS BIGINT) AS lost FROM lineitem")
def s23(spark, sf):
    li = D.table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("decimal(25,8)").alias("value"))
    return li.agg(F.count("*").alias("cells"), F.count_if(~money.survives_double(F.col("value"))).alias("lost"))


def _tree(rows: str, keys: str) -> str:
    """The digest tree of the column p of a SELECT: leaves, sums per first byte, root."""
    words = [f"sum(CAST('0x' || substr(h, {i}, 8) AS BIGINT))" for i in range(1, 65, 8)]
    node = " || ',' || ".join(["substr(h, 1, 2)", "count(*)", *words])
    return (f"SELECT {keys}, sha256(string_agg(node, ';' ORDER BY node)) AS fingerprint FROM (SELECT {keys}, {node} AS node FROM (SELECT *, sha256(octet_length(encode(p)) || ':' || p) AS h FROM ({rows}))"
            f" GROUP BY {keys}, substr(h, 1, 2)) GROUP BY {keys}")


@register("a23_input_fingerprint", sql(_tree("SELECT company_id, statement || '.' || account || '.' || year || '=' || value AS p FROM ledger", "company_id"), "ledger"))
def a23(spark, sf):
    return AU.fingerprint(D.ledger(spark, sf), ["company_id"], F.concat("statement", F.lit("."), "account", F.lit("."), "year", F.lit("="), "value"))


_PARTS = " || ".join(f"octet_length(encode({p})) || ':' || {p}" for p in ("'scheme=2'", "('document=' || sha256(u.s_name))", "('mapping=' || m.fingerprint)", "('scenario=' || s.scenario_id)", "('assumptions=' || a.fingerprint)"))
_MAPPED = ("SELECT document_id AS company_id, fact_id || '|' || account || '|' || mapping_type || '|' || COALESCE(CAST(allocation AS VARCHAR), '') || '|' || sign || '|'"
           " || CASE WHEN document_id % 12 <> 11 THEN 'approved' ELSE 'unapproved' END AS p FROM maps")
_ASSUMED = ("SELECT company_id, scenario_id, code || '@' || year || '=' || value || ':' || status AS p FROM (SELECT company_id, scenario_id, code, year, value, status FROM resolved"
            " UNION ALL SELECT company_id, scenario_id, code, 0, value, status FROM anyres)")


@register("a24_model_version", sql(
    f"SELECT s.company_id, s.scenario_id, sha256({_PARTS}) AS version FROM scenario s JOIN supplier u ON u.s_suppkey = s.company_id JOIN ({_tree(_MAPPED, 'company_id')}) m ON m.company_id = s.company_id"
    f" JOIN ({_tree(_ASSUMED, 'company_id, scenario_id')}) a ON a.company_id = s.company_id AND a.scenario_id = s.scenario_id", "scenario", "maps", "resolved", "anyres"))
def a24(spark, sf):
    """Document, current mappings and resolved assumptions of every scenario as one identifier."""
    f, m = FL.Filing(spark, sf), model(spark, sf)
    return AU.model_version(f.documents, f.mappings, m.resolved_all, m.scenarios)


@register("j35_changed_from_previous", sql("SELECT company_id, statement, year, account, " + sd("before", "before") + ", " + sd("after", "after") + " FROM (SELECT company_id, statement, year, account, value AS before, CASE WHEN account IN ('cash', 'revenue', 'capex') AND (company_id + year) % 2 = 0 THEN value + 1 ELSE value END AS after FROM ledger) WHERE before <> after", "ledger"))
def j35(spark, sf):
    old = D.ledger(spark, sf)
    new = old.withColumn("value", F.expr(f"CAST(CASE WHEN account IN ('cash', 'revenue', 'capex') AND (company_id + year) % 2 = 0 THEN value + 1 ELSE value END AS {money.MONEY})"))
    return as_double(AU.changed_from_previous(old, new, ["company_id", "statement", "year", "account"]), "before", "after")


# One change per company: beta, or capital expenditure, of the base scenario.
_BETA, _CAPEX = "company_id % 2 = 0", "0.09"
_AFTER = {"assumption": f"SELECT * REPLACE (CASE WHEN scenario_id = 'base' AND code = 'beta' AND {_BETA} THEN value + 1 WHEN scenario_id = 'base' AND code = 'capex_pct_revenue' AND NOT ({_BETA}) THEN {_CAPEX} ELSE value END AS value) FROM ({{0}})"}
_PRICED = {"cost_of_equity": "ke", "after_tax_debt": "kd", "wacc": "wacc", "pv_explicit": "pv_explicit", "terminal_value": "tv", "pv_terminal": "pv_terminal", "enterprise_value": "ev", "equity_value": "equity", "per_share": "equity / CAST(m_diluted_shares AS DOUBLE)"}
_FLOWS = ("revenue", "cogs", "operating_expenses", "ebit", "depreciation", "capex", "ppe_net", "accounts_receivable", "inventory", "accounts_payable", "change_in_nwc", "debt", "interest_expense", "pretax_income", "taxes", "net_income",
          "dividends", "retained_earnings", "common_equity", "cfo", "cfi", "cff", "cash", "total_assets", "total_liabilities", "total_equity", "fcff")
# What each of the two changes reaches, written out.
_REACHED = {"beta": ("cost_of_equity", "wacc", "pv_explicit", "terminal_value", "pv_terminal", "enterprise_value", "equity_value", "per_share"),
            "capex_pct_revenue": ("capex", "ppe_net", "depreciation", "cfo", "cfi", "cash", "total_assets", "fcff", "pv_explicit", "terminal_value", "pv_terminal", "enterprise_value", "equity_value", "per_share")}


def _figures_sql() -> str:
    rows = [f"SELECT company_id, scenario_id, year, '{c}' AS target, CAST({c} AS DOUBLE) AS value FROM fc" for c in _FLOWS]
    rows += [f"SELECT s.company_id, s.scenario_id, 0, '{n}', v.x FROM scenario s LEFT JOIN (SELECT company_id, scenario_id, {e} AS x FROM valye) v ON v.company_id = s.company_id AND v.scenario_id = s.scenario_id" for n, e in _PRICED.items()]
    rows += [f"SELECT s.company_id, s.scenario_id, 0, '{c}', NULL FROM scenario s WHERE NOT EXISTS (SELECT 1 FROM fc f WHERE f.company_id = s.company_id AND f.scenario_id = s.scenario_id)" for c in _FLOWS]
    return " UNION ALL ".join(rows)


_OLD, _NEW = (sql(_figures_sql(), "fc", "valye", "scenario", swap=x) for x in (None, _AFTER))
_REACH = values([(c, t) for c, ts in _REACHED.items() for t in ts], "code, target", "rc")
_IMPACT = ("SELECT o.company_id, o.scenario_id, r.code, CAST(o.year AS INTEGER) AS year, o.target, o.value AS before, n.value AS after, CASE WHEN n.value IS NULL THEN 'unavailable' WHEN abs(o.value - n.value) <= 1e-11 * greatest(abs(o.value), abs(n.value)) THEN 'same' ELSE 'moved' END AS state"
           f" FROM ({_OLD}) o JOIN ({_NEW}) n ON n.company_id = o.company_id AND n.scenario_id = o.scenario_id AND n.year = o.year AND n.target = o.target JOIN ({_REACH}) r ON r.target = o.target"
           " AND r.code = CASE WHEN o.company_id % 2 = 0 THEN 'beta' ELSE 'capex_pct_revenue' END")


def impact(spark, sf):
    m = model(spark, sf)
    base = m.assumptions.where("scenario_id = 'base'")
    changes = base.where(f"(code = 'beta' AND {_BETA}) OR (code = 'capex_pct_revenue' AND NOT ({_BETA}))").selectExpr(
        "company_id", "scenario_id", "code", f"CAST(CASE WHEN code = 'beta' THEN value + 1 ELSE {_CAPEX} END AS {money.MONEY}) AS value")
    return IM.preview(m, changes)


@register("j34_impact_preview", f"SELECT company_id, scenario_id, code, year, target, {sd('before', 'before', 1)}, {sd('after', 'after', 1)}, state FROM ({_IMPACT})")
def j34(spark, sf):
    """Beta or capital expenditure of the base scenario changed: every figure it reaches, in every scenario that inherits."""
    return as_double(impact(spark, sf).drop("reason"), "before", "after", places=1)


@register("j34_impact_summary", "SELECT company_id, scenario_id, code, CAST(count(DISTINCT target) AS BIGINT) AS reaches, " + ", ".join(f"CAST(count(*) FILTER (WHERE state = '{s}') AS BIGINT) AS {s}" for s in ("moved", "same", "unavailable")) + f" FROM ({_IMPACT}) GROUP BY 1, 2, 3")
def j34_summary(spark, sf):
    return IM.impact_summary(impact(spark, sf))


@register("l14_scenario_model", f"SELECT company_id, scenario_id, CAST(year AS INTEGER) AS year, target, {sd('value', 'value', 1)} FROM ({_OLD})")
def l14(spark, sf):
    return as_double(IM.scenario_model(model(spark, sf)).drop("reason"), "value", places=1)


METRICS = (
    ("gross_margin_pct", "try_divide(is_gross_profit, is_revenue) * 100", ("is_gross_profit", "is_revenue"), "percent"),
    ("payables_cover", "try_divide(bs_cash, bs_accounts_payable)", ("bs_cash", "bs_accounts_payable"), "multiple"),
    ("net_debt", "bs_debt - bs_cash", ("bs_debt", "bs_cash"), "currency"),
    ("net_debt_to_ebit", "try_divide(net_debt, is_ebit)", ("net_debt", "is_ebit"), "multiple"),
)


@register("x02_evaluate_metrics", sql(" UNION ALL ".join(
    f"SELECT company_id, year, '{n}' AS metric, {sd(f'CAST({e} AS DECIMAL(20,8))', 'value')}, {r} AS reason FROM derived" for n, e, r in (
        ("gross_margin_pct", "is_gross_profit / nullif(is_revenue, 0) * 100", "CASE WHEN is_gross_profit IS NULL THEN 'missing: is_gross_profit' END"),
        ("payables_cover", "bs_cash / nullif(bs_accounts_payable, 0)", "CASE WHEN bs_accounts_payable IS NULL THEN 'missing: bs_accounts_payable' END"),
        ("net_debt", "bs_debt - bs_cash", "NULL"), ("net_debt_to_ebit", "(bs_debt - bs_cash) / nullif(is_ebit, 0)", "NULL"))), "derived"))
def x02(spark, sf):
    return as_double(X.evaluate(full(spark, sf), METRICS).drop("unit"), "value")


@register("x05_recompute_affected", sql("SELECT company_id, year, 'net_debt' AS metric, " + sd("bs_debt - bs_cash", "value") + " FROM derived UNION ALL SELECT company_id, year, 'net_debt_to_ebit', " + sd("CAST((bs_debt - bs_cash) / nullif(is_ebit, 0) AS DECIMAL(20,8))", "value") + " FROM derived", "derived"))
def x05(spark, sf):
    return as_double(X.recompute_affected(full(spark, sf), METRICS, ["bs_debt"]).drop("unit", "reason"), "value")


def _environment_sql() -> str:
    """Each subtotal by its own rule over the derived columns, and the optional terms that were absent."""
    home = {a: {"income": "is_", "balance": "bs_", "cashflow": "cf_"}[s[-1]] + a for a, s, *_ in reversed(dims.CHART)}
    parts = []
    for t, (_, plus, minus) in dims.DERIVATIONS.items():
        terms = [(home[x], "+", x) for x in plus] + [(home[x], "-", x) for x in minus]
        needed = [f"{c} IS NOT NULL" for c, _, x in terms if x not in dims.OPTIONAL_TERMS] or [f"COALESCE({', '.join(c for c, _, _ in terms)}) IS NOT NULL"]
        total = " ".join(f"{sign} COALESCE({c}, 0)" for c, sign, _ in terms)
        nil = [f"CASE WHEN {c} IS NULL THEN '{x}' END" for c, _, x in terms if x in dims.OPTIONAL_TERMS] + ["NULL"]
        parts.append(f"SELECT company_id, year, '{t}' AS metric, CAST(0 {total} AS {M}) AS value, concat_ws(',', {', '.join(nil)}) AS assumed_nil FROM derived WHERE {' AND '.join(needed)}")
    return " UNION ALL ".join(parts)


@register("x04_metric_environment", sql("SELECT company_id, year, metric, " + sd("value", "value") + f", assumed_nil FROM ({_environment_sql()})", "derived"))
def x04(spark, sf):
    return as_double(X.metric_environment(full(spark, sf)), "value")


def _statement_sql(statement: str) -> str:
    px = {"income": "is_", "balance": "bs_", "cashflow": "cf_"}[statement]
    return " UNION ALL ".join(
        f"SELECT company_id, year, '{a}' AS account, {sd(px + a, 'value')}, CASE WHEN {px + a} IS NULL THEN '{PF.NOT_REPORTED}' END AS reason FROM derived" for s, a in dims.slots() if s == statement)


for _s, _key in (("income", "e05_historical_income"), ("balance", "e05_historical_balance"), ("cashflow", "e05_historical_cashflow")):
    def _table(spark, sf, s=_s):
        return as_double(PF.statement_rows(full(spark, sf), s), "value")

    register(_key, sql(_statement_sql(_s), "derived"))(_table)


@register("m18_model_standing", sql(
    "SELECT f.company_id, CASE f.state WHEN 'opening balances' THEN 'Needs Review' WHEN 'drivers' THEN 'Validated' ELSE CASE WHEN m.m_terminal_growth IS NULL THEN 'Forecast Ready' ELSE 'Valuation Ready' END END AS status,"
    " CASE f.state WHEN 'opening balances' THEN 'opening balances' WHEN 'drivers' THEN 'required assumptions' ELSE CASE WHEN m.m_terminal_growth IS NULL THEN 'cost-of-capital inputs' ELSE '' END END AS next_step FROM fstatus f JOIN market m USING (company_id, scenario_id) WHERE f.scenario_id = 'base'", "fstatus", "market"))
def m18(spark, sf):
    return PF.ordered(PF.standing(model(spark, sf).status))


@register("a15_portfolio_cards", sql("SELECT CAST(count(*) AS BIGINT) AS models, CAST(count(*) FILTER (WHERE f.state = 'ok' AND m.m_terminal_growth IS NOT NULL) AS BIGINT) AS valuation_ready, CAST(count(*) FILTER (WHERE f.state = 'opening balances') AS BIGINT) AS needs_review, CAST(count(*) FILTER (WHERE f.state <> 'ok' OR m.m_terminal_growth IS NULL) AS BIGINT) AS unresolved FROM fstatus f JOIN market m USING (company_id, scenario_id) WHERE f.scenario_id = 'base'", "fstatus", "market"))
def a15(spark, sf):
    return PF.cards(PF.standing(model(spark, sf).status))


# ---- export tables ----------------------------------------------------------------------------
_COVER = "SELECT s.company_id, s.scenario_id, s.name, l.first, l.last, f.state FROM scenario s JOIN (SELECT company_id, min(year) AS first, max(year) AS last FROM ledger GROUP BY 1) l USING (company_id) LEFT JOIN fstatus f USING (company_id, scenario_id)"


@register("e01_cover", sql(" UNION ALL ".join(f"SELECT company_id, scenario_id, '{n}' AS field, {e} AS value FROM ({_COVER})" for n, e in (
    ("scenario", "name"), ("first_actual", "CAST(first AS VARCHAR)"), ("last_actual", "CAST(last AS VARCHAR)"), ("forecast", f"'{min(D.FORECAST_YEARS)}-{max(D.FORECAST_YEARS)}'"), ("state", "state"))), "scenario", "ledger", "fstatus"))
def e01(spark, sf):
    return EX.cover(model(spark, sf))


@register("e06_schedules", sql("SELECT company_id, year, schedule, line, " + sd("value", "value") + f", CASE WHEN value IS NULL THEN '{EX.NOT_COMPUTABLE}' END AS reason FROM schedrows", "schedrows"))
def e06(spark, sf):
    return as_double(EX.schedules(model(spark, sf)), "value")


@register("e07_assumptions", sql("SELECT company_id, scenario_id, year, code, " + sd("value", "value", 6) + ", unit, status, source_type, supplied_by, supplied_by <> scenario_id AS inherited FROM resolved", "resolved"))
def e07(spark, sf):
    return as_double(EX.assumptions(model(spark, sf)), "value", places=6)


def _forecast_sql(statement: str) -> str:
    rows = [f"SELECT company_id, 'reported' AS scenario_id, account, year, year || 'A' AS label, {sd('value', 'value', 2)} FROM filled WHERE statement = '{statement}'"]
    for s, a, e, _ in FC.LINES:
        if s == statement:
            e = {"gross_profit": "revenue - cogs", "stock_based_compensation": "sbc", "goodwill": "b_goodwill", "intangibles": "b_intangibles", "lease_liabilities": "b_lease_liabilities", "minority_interest": "b_minority_interest"}.get(a, e)
            rows.append(f"SELECT company_id, scenario_id, '{a}', year, year || 'E', {sd(e, 'value', 2)} FROM fc WHERE ({e}) IS NOT NULL")
    return " UNION ALL ".join(rows)


for _s, _n in (("income", "e08_forecast_income"), ("balance", "e08_forecast_balance"), ("cashflow", "e08_forecast_cashflow")):
    def _forecast(spark, sf, s=_s):
        return as_double(EX.forecast_statement(model(spark, sf), s), "value", places=2)

    register(_n, sql(_forecast_sql(_s), "filled", "fc"))(_forecast)


@register("e09_dcf", sql("SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT company_id, scenario_id, CAST(year AS INTEGER) AS year, '{n}' AS line, {sd(e, 'value', 1)} FROM dyye" for n, e in (("fcff", "CAST(fcff AS DOUBLE)"), ("present_value", "pv"))]
    + [f"SELECT company_id, scenario_id, NULL, '{n}', {sd(e, 'value', 1)} FROM valye" for n, e in (("cost_of_equity", "ke"), ("after_tax_debt", "kd"), ("wacc", "wacc"), ("pv_explicit", "pv_explicit"), ("terminal_value", "tv"),
       ("pv_terminal", "pv_terminal"), ("enterprise_value", "ev"), ("equity_value", "equity"), ("per_share", "equity / CAST(m_diluted_shares AS DOUBLE)"))]) + ") WHERE value IS NOT NULL", "dyye", "valye"))
def e09(spark, sf):
    return as_double(EX.dcf(model(spark, sf)), "value", places=1)


_MISSING = "concat_ws(', ', " + ", ".join(f"CASE WHEN m.m_{c} IS NULL THEN '{c}' END" for c in sorted(c for c, _, r, _ in dims.MARKET_INPUTS if r)) + ")"


@register("e13_limitations", sql(
    "SELECT company_id, scenario_id, 'forecast' AS stage, state AS reason FROM fstatus WHERE state <> 'ok' UNION ALL SELECT company_id, scenario_id, 'valuation', 'missing: ' || missing FROM ("
    f"SELECT s.company_id, s.scenario_id, {_MISSING} AS missing FROM scenario s LEFT JOIN market m USING (company_id, scenario_id)) WHERE missing <> ''", "fstatus", "market", "scenario"))
def e13(spark, sf):
    return EX.limitations(model(spark, sf))
