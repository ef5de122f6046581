"""The thirty-clause registry panel of every scenario, with what stopped a clause that could not run.

Four tables answer: the filing's evidence and the historical clauses, one row per company, and the assumption, forecast and valuation
clauses, one row per scenario. Each answer sits in a map from clause to (status, detail), so the panel is two joins on
the company clustering and one projection that unrolls the registry. Stages form a chain (statements, forecast, valuation); the
first stage that did not build stops every clause behind it, and the clause says which stage and why. A clause that did not run is
SKIP, never PASS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import dims, money
from ..session import cut_lineage
from . import checks as C
from . import forecast as FC
from . import ledger as L
from . import mapping as MP
from . import review as RV
from . import scenarios as S
from . import schedules as H
from .ledger import stacked

K = FC.K
# What has to be built before a clause can be asked. Clauses not listed need nothing.
NEEDS = {c: "statements" for c in ("17.3", "17.8", "17.9", "17.10", "17.11", "17.12", "17.13", "17.14", "17.15", "17.18", "17.19", "17.27", "17.29", "17.30")}
NEEDS |= {c: "forecast" for c in ("17.16", "17.17", "17.20")} | {c: "valuation" for c in ("17.22", "17.23", "17.24", "17.25", "17.26")}
UNEVALUABLE = {
    "17.21": "no iterative calculation is configured, and derivations with a cycle are refused when they are loaded",
    "17.28": "a claim about the test report, which a run does not see",
}
HISTORICAL = {"historical balance sheet balances": "17.8", "historical cash flow reconciles": "17.9", "reported subtotals reconcile": "17.10"}
SCHEDULES = {"ppe": "17.11", "intangibles": "17.12", "debt": "17.13", "retained_earnings": "17.15"}
FORECAST = {"forecast balance sheet balances": "17.16", "ending cash linkage": "17.17", "no forecast hardcodes": "17.20", "FCFF matches the statements": "17.22"}
ANSWER = "STRUCT<status: STRING, detail: STRING>"
COST_OF_CAPITAL = [c for c, _, required, _ in dims.MARKET_INPUTS if required and c != "terminal_growth"]


def named(rows: DataFrame, column: str, clauses: dict[str, str]) -> DataFrame:
    """Rows of a check table under their clause."""
    pairs = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in clauses.items()) + ")"
    return rows.withColumn("clause", F.expr(f"{pairs}[{column}]")).where("clause IS NOT NULL")


def answers(rows: DataFrame, *keys: str) -> DataFrame:
    """clause -> (status, detail) per key, from rows of clause, status and detail."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("clause", F.struct("status", "detail")))).alias("answers"))


def _wide_answers(rows: DataFrame, keys: tuple[str, ...], clauses: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows of clause, status, detail from (clause, passes, detail if so, detail if not) over one row per key."""
    cells = [(f"'{c}'", f"CASE WHEN coalesce({ok}, false) THEN 'PASS' ELSE 'FAIL' END", f"CASE WHEN coalesce({ok}, false) THEN {good} ELSE {bad} END") for c, ok, good, bad in clauses]
    return rows.selectExpr(*keys, stacked(cells, ("clause", "status", "detail")))


def filing_evidence(facts: DataFrame, mappings: DataFrame, documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per company: counts of its facts by state, double counts, lines without lineage, and why the statements
    do not build strictly. documents: document_id, metadata_confirmed, scale_confirmed, currency_confirmed, hash, found_hash.

    Over facts and mappings that lie clustered on the document no row moves. The three counts are stage tables of their own, of a row per
    document, because one task for all would hold the memory of all their sorts at once."""
    gated = RV.gates(facts, MP.fact_mapping_state(mappings), documents)
    used = F.col("mapping_approved").isNotNull() & ~F.col("excluded") & F.col("value").isNotNull()
    per = cut_lineage(gated.groupBy("document_id").agg(
        F.count("*").alias("facts"), F.count_if("verified").alias("verified"), F.count_if("unmapped").alias("unmapped"),
        F.count_if(used & ~F.col("mapping_approved")).alias("unapproved"), F.count_if(used & ~F.col("verified")).alias("unverified"), F.count_if(used).alias("used"),
    ), "document_id")
    twice = cut_lineage(MP.double_count_groups(mappings, facts).select("document_id").unionByName(MP.double_count_within_fact(mappings).select("document_id")).groupBy("document_id").agg(F.count("*").alias("double_counts")), "document_id")
    bare = cut_lineage(MP.trace(mappings, facts, ledger).where("NOT has_lineage").groupBy(F.col("company_id").alias("document_id")).agg(F.count("*").alias("bare")), "document_id")
    d = documents.join(per, "document_id", "left").join(twice, "document_id", "left").join(bare, "document_id", "left")
    return d.selectExpr(
        "document_id AS company_id", "hash", "found_hash", "scale_confirmed", "currency_confirmed", *[f"coalesce({c}, 0) AS {c}" for c in ("facts", "verified", "unmapped", "double_counts", "bare")],
        "CASE WHEN coalesce(used, 0) = 0 THEN 'no mapped figure' WHEN unapproved > 0 THEN concat(unapproved, ' mappings not approved') WHEN unverified > 0 THEN concat(unverified, ' facts not verified') END AS build_error",
    )


_UNCONFIRMED = "array_join(array_compact(array(CASE WHEN NOT coalesce(scale_confirmed, false) THEN 'displayed_scale' END, CASE WHEN NOT coalesce(currency_confirmed, false) THEN 'reporting_currency' END)), ', ')"
SOURCE_CLAUSES = [
    ("17.1", "hash = found_hash", "'the stored hash matches'", "'the stored hash does not match'"),
    ("17.2", f"{_UNCONFIRMED} = ''", "'every required field is confirmed'", f"concat('not confirmed: ', {_UNCONFIRMED})"),
    ("17.4", "scale_confirmed AND currency_confirmed", "'currency and scale are confirmed'", f"concat('not confirmed: ', {_UNCONFIRMED})"),
    ("17.5", "facts > 0 AND verified = facts", "concat(facts, ' facts verified')", "concat(verified, ' of ', facts, ' facts verified')"),
    ("17.6", "facts > 0 AND unmapped = 0", "'every fact is mapped or excluded'", "concat(unmapped, ' facts without a mapping')"),
    ("17.7", "double_counts = 0", "'no fact counts twice'", "concat(double_counts, ' double counts')"),
    ("17.30", "bare = 0", "'every line cites a page or its formula'", "concat(bare, ' lines cite nothing')"),
]


def historical_answers(m) -> DataFrame:
    """Clauses over the reported years of each company: company_id, clause, status, detail."""
    keys = ("company_id",)
    past = named(C.historical_checks(m.filled), "check_name", HISTORICAL).select(*keys, "clause", "status", "detail")
    ties = named(H.reconcile(H.reconciliations(m.filled)), "schedule", SCHEDULES).selectExpr(
        *keys, "clause", "status", "CASE WHEN checked = 0 THEN 'no period has an opening balance and movements' ELSE concat(checked, ' periods, ', failed, ' out') END AS detail"
    )
    tax = H.effective_tax(m.filled).groupBy(*keys).agg(F.count_if("usable").alias("n")).selectExpr(
        *keys, "'17.14' AS clause", "CASE WHEN n > 0 THEN 'PASS' ELSE 'SKIP' END AS status", "CASE WHEN n > 0 THEN concat(n, ' usable rates') ELSE 'no period yields a usable rate' END AS detail"
    )
    shown = F.translate(money.display(F.col("value"), 1), ",", "").cast(money.MONEY)
    off = shown.isNull() | (shown != F.bround("value", 1).cast(money.MONEY)) | ((shown != F.col("value")) != money.is_rounded(F.col("value"), 1))
    prints = L.to_long(m.filled).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(off).alias("bad")).selectExpr(
        *keys, "'17.29' AS clause", "CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status", "concat(n, ' displayed values, ', bad, ' do not read back') AS detail"
    )
    whole = prints.selectExpr(*keys, "'17.27' AS clause", "'PASS' AS status", "'every reported value is a number' AS detail")
    axis = _wide_answers(m.axis, keys, [("17.3", "period_problem IS NULL", "concat(size(actual_years), ' actual and ', size(forecast_years), ' forecast years')", "period_problem")])
    return past.unionByName(ties).unionByName(tax).unionByName(prints).unionByName(whole).unionByName(axis)


def scenario_answers(m) -> DataFrame:
    """Clauses over assumptions, forecast and valuation of each scenario: keys, clause, status, detail, and the row's stage errors."""
    dated = "url IS NOT NULL OR date IS NOT NULL" if {"url", "date"} <= set(m.resolved_all.columns) else "false"
    inputs = ", ".join(f"'{c}'" for c in COST_OF_CAPITAL)
    known = m.resolved_all.where(f"year = {S.NO_PERIOD}").groupBy(*K).agg(
        F.expr("array_sort(collect_set(CASE WHEN status = 'Rejected' THEN code END)) AS rejected"),
        F.expr(f"array_sort(collect_set(CASE WHEN code IN ({inputs}) AND NOT ({dated}) THEN code END)) AS undated"),
    )
    gate = m.prepared.select(*K, "blocked_by").join(known, list(K), "left").selectExpr(*K, "blocked_by", "coalesce(array_join(rejected, ', '), '') AS rejected", "coalesce(array_join(undated, ', '), '') AS undated")
    of_gate = _wide_answers(gate, K, [
        ("17.18", "blocked_by IS NULL OR NOT startswith(blocked_by, 'drivers')", "'every required assumption is usable'", "blocked_by"),
        ("17.19", "rejected = ''", "'no rejected assumption'", "concat('rejected: ', rejected)"),
        ("17.23", "undated = ''", "'every cost-of-capital input is dated'", "concat('not dated: ', undated)"),
    ])
    v = m.valuation.selectExpr(*K, "blocked_by", "wacc", "terminal_growth", "enterprise_value", "equity_value", "per_share", "array_join(assumed_nil, ', ') AS nil")
    of_value = _wide_answers(v, K, [
        ("17.24", "wacc > terminal_growth", "'WACC is above terminal growth'", "'WACC is at or below terminal growth'"),
        ("17.25", "nil = ''", "'every bridge line is stated'", "concat('taken as nil: ', nil)"),
        ("17.27", "wacc IS NOT NULL AND (blocked_by IS NOT NULL OR (enterprise_value IS NOT NULL AND equity_value IS NOT NULL))", "'every released value is a number'", "'a released value is missing'"),
    ])
    shares = v.selectExpr(*K, "'17.26' AS clause", "CASE WHEN per_share IS NOT NULL THEN 'PASS' ELSE 'SKIP' END AS status", "CASE WHEN per_share IS NOT NULL THEN 'diluted shares are stated' ELSE 'no diluted share count' END AS detail")
    ahead = named(C.verdict(C.forecast_tally(m.forecast), K), "check_name", FORECAST).select(*K, "clause", "status", "detail")
    return of_gate.unionByName(of_value).unionByName(shares).unionByName(ahead)


def stage_errors(m) -> DataFrame:
    """Why a scenario's forecast or valuation did not build. WACC at or below growth is an answer of 17.24, not a stage."""
    v = m.valuation.selectExpr(*K, "CASE WHEN wacc <= terminal_growth THEN NULL ELSE blocked_by END AS valuation_error")
    return m.prepared.selectExpr(*K, "blocked_by AS forecast_error").join(v, list(K), "left")


def evaluate(m, evidence: DataFrame | None = None) -> DataFrame:
    """company_id, scenario_id, code, clause, severity, stage, compares, status, detail, blocked_by: thirty rows per scenario (C17).
    Without the filing's evidence its clauses are SKIP, so nothing can be released."""
    known = m.filled.groupBy("company_id").agg(F.count("*").alias("n_years"))
    past = historical_answers(m)
    if evidence is not None:
        past = past.unionByName(_wide_answers(evidence, ("company_id",), SOURCE_CLAUSES))
    company = answers(past, "company_id").withColumnRenamed("answers", "of_company")
    scenario = answers(scenario_answers(m), *K).withColumnRenamed("answers", "of_scenario")
    rows = m.scenarios.select(*K).join(company, "company_id", "left").join(known, "company_id", "left")
    rows = rows.join(evidence.select("company_id", "build_error"), "company_id", "left") if evidence is not None else rows.withColumn("build_error", F.lit(None).cast("string"))
    rows = rows.join(stage_errors(m), list(K), "left").join(scenario, list(K), "left")
    # one fold over the chain of stages: what stops a stage is the first error at it or before it
    chain = "array(named_struct('stage', 'statements', 'error', CASE WHEN n_years IS NULL THEN 'no reported line' ELSE build_error END), named_struct('stage', 'forecast', 'error', forecast_error), named_struct('stage', 'valuation', 'error', valuation_error))"
    fold = (
        f"aggregate({chain}, CAST(map() AS MAP<STRING, STRING>), (seen, s) -> map_concat(seen, map(s.stage,"
        " coalesce(try_element_at(map_values(seen), -1), CASE WHEN s.error IS NOT NULL THEN concat(s.stage, ': ', s.error) END))))"
    )
    rows = rows.selectExpr(*K, "of_company", "of_scenario", f"{fold} AS stopped")
    cells = []
    for code, clause, severity, _, compares, stage in dims.CHECK_REGISTRY:
        stop = f"stopped['{NEEDS[clause]}']" if clause in NEEDS else "CAST(NULL AS STRING)"
        said = f"coalesce(of_scenario['{clause}'], of_company['{clause}'])"
        why = f"'{UNEVALUABLE[clause]}'" if clause in UNEVALUABLE else "'not evaluated'"
        cells.append((
            f"'{code}'", f"'{clause}'", f"'{severity}'", f"'{stage}'", f"'{compares}'",
            f"CASE WHEN {stop} IS NOT NULL THEN 'SKIP' ELSE coalesce({said}.status, 'SKIP') END",
            f"CASE WHEN {stop} IS NOT NULL THEN concat('the ', '{NEEDS.get(clause, '')}', ' did not build') ELSE coalesce({said}.detail, {why}) END", stop,
        ))
    return rows.selectExpr(*K, stacked(cells, ("code", "clause", "severity", "stage", "compares", "status", "detail", "blocked_by")))
