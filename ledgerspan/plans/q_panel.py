"""Registered queries: the registry panel over filings whose statements tie, with the faults that some carry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import checks as C
from ..operators import exports as EX
from ..operators import panel as PN
from ..operators import portfolio as PF
from ..operators import schedules as H
from ..session import cut_lineage, stage_root
from ..sources import derived as D
from ..sources import filings as FL
from . import q_filing  # noqa: F401  (its common table expressions)
from .duck import CTES, M, R, cte, q, sql, values
from .model import Model
from .q_ledger import close_sql, full
from .q_model import _FLOW, _PANEL_NEEDS, _PANEL_SQL, _REC as _ALL_REC, _SUBTOTALS, _fore, _hist_check
from .registry import register

SETTLED = "document_id % 2 = 1 OR document_id % 5 = 0"
_SCALE, _CURRENCY = FL.SCALE_OK.replace("company_id", "n.document_id"), FL.CURRENCY_OK.replace("company_id", "n.document_id")
STALE = "document_id % 21 = 20"  # files that changed after they were stored


def tied_model(spark, sf) -> Model:
    years = cut_lineage(D.company_year(spark, sf))  # the transactions are read once for ledger and drivers
    a = D.assumptions(spark, sf, rows=D.TIED_ASSUMPTIONS, years=years).selectExpr("*", f"{D.OBSERVED} AS date", "CAST(NULL AS STRING) AS url")
    return Model(D.tied_ledger(spark, sf, years), D.scenarios(spark, sf), a, D.FORECAST_YEARS)


def filing(spark, sf, ledger=None):
    """The filings of the companies that tie, over a ledger that is staged already or is staged here."""
    return FL.Filing(spark, sf, cut_lineage(D.tied_ledger(spark, sf), "company_id") if ledger is None else ledger, SETTLED)


def evidence(f):
    printed, _ = FL.MP.build_ledger(FL.MP.normalise(f.mappings, f.reviewed))
    documents = f.documents.selectExpr("*", f"CASE WHEN {STALE} THEN reverse(hash) ELSE hash END AS found_hash")
    return PN.filing_evidence(f.reviewed, f.mappings, documents, printed)


def panel(spark, sf):
    """Over staged tables: the model and the filings share one ledger."""
    m = tied_model(spark, sf).staged(stage_root(spark))
    return PN.evaluate(m, cut_lineage(evidence(filing(spark, sf, m.ledger)), "company_id"))


# ---- the same in SQL --------------------------------------------------------------------------
def _tied_sql() -> str:
    inner = "cy"
    for layer in D.TIED_LAYERS:
        inner = f"(SELECT *, {', '.join(f'CAST({e} AS {M}) AS {n}' if n != 'n' else f'{e} AS {n}' for n, e in layer)} FROM {inner})"
    rows = " UNION ALL ".join(f"SELECT company_id, '{s}' AS statement, '{a}' AS account, year, CAST({e} AS {M}) AS value FROM {inner}" for s, a, e in D.TIED_LINES)
    return f"SELECT * FROM ({rows}) WHERE value IS NOT NULL"


_ASSUMPTION_SQL = " UNION ALL ".join(
    f"SELECT company_id, {q(s)} AS scenario_id, {q(c)} AS code, CAST({q(p)} AS INTEGER) AS period, {q(u)} AS unit,"
    f" CAST({'CAST(' + v + ' AS ' + R + ')' if u in ('ratio', 'days') else v} AS {M}) AS value, {q(st)} AS status, {q(src)} AS source_type, {i} AS seq FROM lastact WHERE {k}"
    for i, (s, c, p, u, v, st, src, k) in enumerate(D.TIED_ASSUMPTIONS))
_THIRD = "CASE WHEN (document_id + rw + cl) % 17 = 0 AND parsed IS NOT NULL AND (" + SETTLED + ") THEN 'accepted' WHEN"
TIED = {"ledger": _tied_sql(), "assumption": _ASSUMPTION_SQL, "xrev": CTES["xrev"][1].replace("CASE WHEN (document_id + rw + cl) % 17 = 0 AND cl = 4 THEN 'accepted' WHEN", _THIRD + " (document_id + rw + cl) % 17 = 0 AND cl = 4 THEN 'accepted' WHEN")}
assert TIED["xrev"] != CTES["xrev"][1]

cte("pgate", f"SELECT x.document_id, x.value, x.status IN ('accepted', 'corrected') AND len(x.outstanding) = 0 AND ({FL.SCALE_OK}) AND ({FL.CURRENCY_OK}) AS done, m.document_id % 12 <> 11 AS mapped FROM xrev x LEFT JOIN (SELECT DISTINCT document_id, fact_id FROM maps) m USING (document_id, fact_id)", "xrev", "maps")
_TWICE = ("SELECT DISTINCT a.document_id FROM maps a JOIN (" + values([(a, u) for a, us in dims.ancestors().items() for u in sorted(us)], "account, ancestor", "c")
          + ") c USING (account) JOIN maps o ON o.document_id = a.document_id AND o.fact_id = a.fact_id AND o.account = c.ancestor")
cte("pevid", "SELECT s.s_suppkey AS company_id, g.facts, g.verified, g.unmapped, t.document_id IS NOT NULL AS twice,"
    " CASE WHEN COALESCE(g.used, 0) = 0 THEN 'no mapped figure' WHEN g.unapproved > 0 THEN g.unapproved || ' mappings not approved' WHEN g.unverified > 0 THEN g.unverified || ' facts not verified' END AS build_error"
    " FROM supplier s LEFT JOIN (SELECT document_id, count(*) AS facts, count(*) FILTER (WHERE done AND mapped) AS verified, count(*) FILTER (WHERE mapped IS NULL) AS unmapped, count(*) FILTER (WHERE mapped IS NOT NULL AND value IS NOT NULL) AS used,"
    " count(*) FILTER (WHERE NOT mapped AND value IS NOT NULL) AS unapproved, count(*) FILTER (WHERE mapped IS NOT NULL AND value IS NOT NULL AND NOT (done AND mapped)) AS unverified FROM pgate GROUP BY 1) g ON g.document_id = s.s_suppkey"
    f" LEFT JOIN (SELECT document_id FROM dbl UNION SELECT document_id FROM ({_TWICE})) t ON t.document_id = s.s_suppkey", "pgate", "dbl", "maps")
_REC = "SELECT company_id, schedule, computed_ending AS computed, reported_ending AS reported FROM roll"
cte("phist", " UNION ALL ".join([
    f"SELECT company_id, '17.8' AS clause, status FROM ({_hist_check('x', 'bs_total_assets', '(bs_total_liabilities + bs_total_equity)')})",
    f"SELECT company_id, '17.9', status FROM ({_hist_check('x', f'(prev_bs_cash + {_FLOW})', 'bs_cash', 'n > 1')})",
    f"SELECT company_id, '17.10', status FROM ({_SUBTOTALS})",
    "SELECT company_id, CASE schedule " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in PN.SCHEDULES.items()) + " END, CASE WHEN count(computed - reported) = 0 THEN 'SKIP' WHEN count(*) FILTER (WHERE NOT "
    + close_sql("computed", "reported") + f") > 0 THEN 'FAIL' ELSE 'PASS' END FROM ({_REC}) WHERE schedule <> 'common_equity' GROUP BY company_id, schedule",
    "SELECT company_id, '17.14', CASE WHEN count(*) FILTER (WHERE rate >= 0 AND rate < 1) > 0 THEN 'PASS' ELSE 'SKIP' END FROM tax GROUP BY company_id",
    f"SELECT company_id, '17.29', CASE WHEN bool_and(abs(CAST(CAST(round_even(value, 1) AS VARCHAR) AS {M}) - value) <= 0.05) THEN 'PASS' ELSE 'FAIL' END FROM filled GROUP BY company_id",
    f"SELECT company_id, '17.3', CASE WHEN bool_and(p IS NULL OR year = p + 1) AND max(year) + 1 = {D.FORECAST_YEARS[0]} THEN 'PASS' ELSE 'FAIL' END FROM (SELECT company_id, year, lag(year) OVER (PARTITION BY company_id ORDER BY year) AS p FROM wide) GROUP BY company_id",
]), "prevd", "drvf", "roll", "tax", "filled", "wide")
_CHECKS = {"forecast balance sheet balances": ("total_assets", "(total_liabilities + total_equity)"), "ending cash linkage": ("(pc + cfo + cfi + cff)", "cash"),
           "FCFF matches the statements": ("fcff", f"(ebit - CAST(ebit * CAST(tax_rate AS DECIMAL(12,8)) AS {M}) + depreciation - capex - change_in_nwc)")}
cte("pscen", " UNION ALL ".join(
    [f"SELECT company_id, scenario_id, '{PN.FORECAST[n]}' AS clause, status FROM ({_fore(n, a, b)})" for n, (a, b) in _CHECKS.items()]
    + ["SELECT company_id, scenario_id, '17.20', CASE WHEN count(*) FILTER (WHERE revenue_growth IS NULL OR dso IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END FROM fc GROUP BY 1, 2",
       "SELECT s.company_id, s.scenario_id, '17.18', CASE WHEN count(p.problem) = 0 THEN 'PASS' ELSE 'FAIL' END FROM scenario s LEFT JOIN gatep p USING (company_id, scenario_id) GROUP BY 1, 2",
       "SELECT s.company_id, s.scenario_id, '17.19', CASE WHEN count(r.code) = 0 THEN 'PASS' ELSE 'FAIL' END FROM scenario s LEFT JOIN (SELECT * FROM anyres WHERE status = 'Rejected') r USING (company_id, scenario_id) GROUP BY 1, 2",
       "SELECT company_id, scenario_id, '17.23', CASE WHEN company_id % 13 = 6 THEN 'FAIL' ELSE 'PASS' END FROM scenario",
       "SELECT company_id, scenario_id, '17.24', CASE WHEN wacc > g THEN 'PASS' ELSE 'FAIL' END FROM valye",
       "SELECT company_id, scenario_id, '17.25', CASE WHEN " + " AND ".join(f"m_{c} IS NOT NULL" for c, _, _, g in dims.MARKET_INPUTS if g == "bridge" and c != "diluted_shares") + " THEN 'PASS' ELSE 'FAIL' END FROM valye",
       "SELECT company_id, scenario_id, '17.26', CASE WHEN equity / m_diluted_shares IS NOT NULL THEN 'PASS' ELSE 'SKIP' END FROM valye"]), "fcp", "fc", "scenario", "gatep", "anyres", "valye")
cte("pstop", "SELECT s.company_id, s.scenario_id, CASE WHEN l.company_id IS NULL THEN 'statements: no reported line' WHEN e.build_error IS NOT NULL THEN 'statements: ' || e.build_error END AS s1, CASE WHEN f.state <> 'ok' THEN 'forecast: ' || f.state END AS s2,"
    " CASE WHEN v.company_id IS NULL THEN NULL WHEN v.g IS NULL THEN 'valuation: terminal_growth not supplied' WHEN v.wacc IS NULL THEN 'valuation: cost of capital not supplied' END AS s3"
    " FROM scenario s LEFT JOIN (SELECT DISTINCT company_id FROM ledger) l USING (company_id) LEFT JOIN pevid e USING (company_id) LEFT JOIN fstatus f USING (company_id, scenario_id) LEFT JOIN valye v USING (company_id, scenario_id)", "scenario", "ledger", "pevid", "fstatus", "valye")
_CLAUSES = values([(c, cl, sv, st, t, PN.NEEDS.get(cl, "")) for c, cl, sv, _, t, st in dims.CHECK_REGISTRY], "code, clause, severity, stage, compares, needs", "rg")
cte("fullpanel", "SELECT company_id, scenario_id, code, clause, severity, stage, compares, stop AS blocked_by, CASE WHEN stop IS NOT NULL THEN 'SKIP' ELSE COALESCE(answer, 'SKIP') END AS status FROM ("
    "SELECT p.company_id, p.scenario_id, rg.*, CASE rg.needs WHEN 'statements' THEN p.s1 WHEN 'forecast' THEN COALESCE(p.s1, p.s2) WHEN 'valuation' THEN COALESCE(p.s1, p.s2, p.s3) END AS stop,"
    " COALESCE(x.status, h.status, CASE rg.clause WHEN '17.1' THEN CASE WHEN p.company_id % 21 = 20 THEN 'FAIL' ELSE 'PASS' END"
    f" WHEN '17.2' THEN CASE WHEN {FL.SCALE_OK.replace('company_id', 'p.company_id')} AND {FL.CURRENCY_OK.replace('company_id', 'p.company_id')} THEN 'PASS' ELSE 'FAIL' END"
    f" WHEN '17.4' THEN CASE WHEN {FL.SCALE_OK.replace('company_id', 'p.company_id')} AND {FL.CURRENCY_OK.replace('company_id', 'p.company_id')} THEN 'PASS' ELSE 'FAIL' END"
    " WHEN '17.5' THEN CASE WHEN e.facts = e.verified THEN 'PASS' ELSE 'FAIL' END WHEN '17.6' THEN CASE WHEN e.unmapped = 0 THEN 'PASS' ELSE 'FAIL' END"
    " WHEN '17.7' THEN CASE WHEN e.twice THEN 'FAIL' ELSE 'PASS' END WHEN '17.27' THEN CASE WHEN v.company_id IS NOT NULL AND v.wacc IS NULL THEN 'FAIL' ELSE 'PASS' END WHEN '17.30' THEN CASE WHEN e.build_error IS NULL THEN 'PASS' END END) AS answer"
    f" FROM pstop p CROSS JOIN ({_CLAUSES}) rg LEFT JOIN pscen x ON x.company_id = p.company_id AND x.scenario_id = p.scenario_id AND x.clause = rg.clause LEFT JOIN phist h ON h.company_id = p.company_id AND h.clause = rg.clause"
    " LEFT JOIN pevid e ON e.company_id = p.company_id LEFT JOIN valye v ON v.company_id = p.company_id AND v.scenario_id = p.scenario_id)", "pstop", "pscen", "phist", "pevid", "valye")


def tied_sql(select: str) -> str:
    return sql(select, "fullpanel", swap=TIED)


def _stop():
    """The stage and its first words; what follows a second colon is detail."""
    return F.regexp_extract("blocked_by", "^[^:]*(: [^:]*)?", 0)


@register("c17_registry_panel", tied_sql("SELECT company_id, scenario_id, clause, severity, status, blocked_by FROM fullpanel"))
def c17(spark, sf):
    return panel(spark, sf).select("company_id", "scenario_id", "clause", "severity", "status", _stop().alias("blocked_by"))


_OPEN = f"status <> 'PASS' AND clause NOT IN ({', '.join(q(c) for c in dims.NOT_ACTIONABLE)})"


@register("c22_release_readiness", tied_sql(
    f"SELECT company_id, scenario_id, CAST(count(*) FILTER (WHERE {_OPEN}) AS BIGINT) AS blocking, CAST(count(*) FILTER (WHERE {_OPEN} AND severity = 'CRITICAL') AS BIGINT) AS critical, count(*) FILTER (WHERE {_OPEN}) = 0 AS releasable FROM fullpanel GROUP BY 1, 2"))
def c22(spark, sf):
    return PF.readiness(panel(spark, sf))


@register("c23_stage_checklist", tied_sql("SELECT company_id, scenario_id, stage, " + ", ".join(f"CAST(count(*) FILTER (WHERE status = '{x}') AS BIGINT) AS {x.lower()}" for x in ("PASS", "FAIL", "SKIP")) + " FROM fullpanel GROUP BY 1, 2, 3"))
def c23(spark, sf):
    return PF.stage_checklist(panel(spark, sf))


@register("a12_severity_summary", tied_sql("SELECT severity, clause, " + ", ".join(f"CAST(count(*) FILTER (WHERE status = '{x}') AS BIGINT) AS {x.lower()}" for x in ("PASS", "FAIL", "SKIP")) + " FROM fullpanel GROUP BY ROLLUP (severity, clause)"))
def a12_severity(spark, sf):
    return C.counts(panel(spark, sf), "severity", "clause")


@register("e11_checks", tied_sql("SELECT company_id, scenario_id, code, clause, compares, status, severity, stage, blocked_by FROM fullpanel"))
def e11(spark, sf):
    return EX.checks(panel(spark, sf)).drop("detail").withColumn("blocked_by", _stop())


# ---- the check sets behind the panel ------------------------------------------------------------
_C12 = "SELECT company_id, schedule || ' reconciles' AS check_name, CASE WHEN count(computed - reported) = 0 THEN 'SKIP' WHEN count(*) FILTER (WHERE NOT " + close_sql("computed", "reported") + f") > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({_ALL_REC}) GROUP BY company_id, schedule"


@register("c15_schedule_check_set", sql(
    _C12 + " UNION ALL SELECT company_id, 'interest basis matches the forecast', CASE WHEN count(CASE WHEN prev_bs_debt <> 0 THEN is_interest_expense / prev_bs_debt END) = 0 THEN 'SKIP' ELSE 'PASS' END FROM prevd WHERE n > 1 GROUP BY company_id"
    " UNION ALL SELECT company_id, 'schedules are available or explained', CASE WHEN bool_or(partial AND why = '') THEN 'FAIL' ELSE 'PASS' END FROM (SELECT company_id, schedule, bool_or(computed_ending IS NULL OR absent <> '') AS partial,"
    " string_agg(CASE WHEN computed_ending IS NULL THEN 'no opening' WHEN absent <> '' THEN absent END, '') AS why FROM roll GROUP BY 1, 2) GROUP BY company_id", "roll", "wc2", "prevd"))
def c15(spark, sf):
    """C12, C13 and C14 as one set."""
    return H.schedule_checks(full(spark, sf)).drop("detail")


@register("c10_cells_cited_and_verified", sql(
    "SELECT company_id, CAST(count(*) AS BIGINT) AS cells, k.check_name, CAST(CASE WHEN k.check_name = 'every cell cites a page' THEN 0 ELSE count(*) FILTER (WHERE NOT sound) END AS BIGINT) AS broken,"
    " CASE WHEN k.check_name = 'every cell is verified' AND count(*) FILTER (WHERE NOT sound) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ("
    f"SELECT n.document_id AS company_id, n.account, n.period_label, n.statement, bool_and(x.status IN ('accepted', 'corrected') AND len(x.outstanding) = 0 AND ({_SCALE}) AND ({_CURRENCY})) AS sound FROM norm n JOIN mj m ON m.document_id = n.document_id AND m.account = n.account AND m.period_label = n.period_label AND m.statement = n.statement"
    " JOIN xrev x ON x.document_id = m.document_id AND x.fact_id = m.fact_id WHERE n.value IS NOT NULL AND n.document_id % 12 <> 11 GROUP BY 1, 2, 3, 4), (VALUES ('every cell cites a page'), ('every cell is verified')) k(check_name) GROUP BY company_id, k.check_name", "norm", "mj", "xrev"))
def c10(spark, sf):
    """C10 and C11 over the filings."""
    f = FL.Filing(spark, sf)
    led, _ = FL.MP.build_ledger(FL.MP.normalise(f.mappings, f.reviewed))
    return FL.MP.cell_checks(f.mappings, f.reviewed, led, FL.RV.gates(f.reviewed, FL.MP.fact_mapping_state(f.mappings), f.documents))


@register("c16_forecast_readiness", sql(
    "SELECT s.company_id, CAST(count(*) AS BIGINT) AS scenarios, COALESCE(string_agg(CASE WHEN f.state <> 'ok' THEN s.scenario_id END, ', ' ORDER BY s.scenario_id), '') AS not_built,"
    " COALESCE(any_value(b.open), '') AS open, bool_and(f.state = 'ok') AND any_value(b.open) IS NULL AS forecast_ready FROM scenario s JOIN fstatus f USING (company_id, scenario_id) LEFT JOIN ("
    "SELECT company_id, string_agg(DISTINCT scenario_id || ': ' || check_name || ' ' || status, '; ' ORDER BY scenario_id || ': ' || check_name || ' ' || status) AS open FROM (" + _PANEL_SQL + f") WHERE status <> 'PASS' AND check_name NOT IN ({', '.join(q(c) for c in C.NEEDS_VALUATION)}) GROUP BY 1) b"
    " ON b.company_id = s.company_id GROUP BY s.company_id", "scenario", "fstatus", *_PANEL_NEEDS, swap={k: v for k, v in TIED.items() if k != "xrev"}))
def c16(spark, sf):
    """Whether every scenario of a company is forecast and holds, over the statements that tie."""
    m = tied_model(spark, sf).staged(stage_root(spark))
    return C.forecast_readiness(m.checks, m.status)
