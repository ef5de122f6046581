"""The export tables of a model, long form: one row per line and period, absent figures with their reason.

Every builder takes the lazy model; `export_set` returns them by name for `writers.export_tables`. Stage the model
first (`Model.staged`), so that the tables share one ledger and one forecast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..money import MONEY
from . import forecast as FC
from . import ledger as L
from . import panel as PN
from . import portfolio as PF
from . import schedules as H
from .ledger import stacked

K = FC.K
NOT_COMPUTABLE = "not computable from the reported lines"


def cover(m) -> DataFrame:
    """field, value of every company and scenario."""
    span = m.axis.selectExpr("company_id", "element_at(actual_years, 1) AS first", "last_actual AS last", "forecast_years")
    state = m.status.selectExpr(*K, "CASE WHEN may_calculate THEN 'ok' ELSE split(blocked_by, ':')[0] END AS state")
    rows = [("'scenario'", "name"), ("'first_actual'", "CAST(first AS STRING)"), ("'last_actual'", "CAST(last AS STRING)"),
            ("'forecast'", "concat(element_at(forecast_years, 1), '-', element_at(forecast_years, -1))"), ("'state'", "state")]
    wide = m.scenarios.select(*K, "name").join(span, "company_id").join(state, list(K), "left")
    return wide.selectExpr(*K, stacked(rows, ("field", "value")))


def sources(documents: DataFrame, gated: DataFrame) -> DataFrame:
    """The filing of each company: name, stored hash, pages and facts read, metadata and verification state.

    gated: facts with their verification gates (`review.gates`)."""
    per = gated.groupBy("document_id").agg(F.max("page").alias("pages"), F.count(F.lit(1)).alias("facts"), F.count_if("verified").alias("verified"))
    return documents.join(per, "document_id", "left").selectExpr(
        "document_id AS company_id", "company_name", "hash", "coalesce(pages, 0) AS pages", "coalesce(facts, 0) AS facts", "coalesce(verified, 0) AS verified",
        "CASE WHEN metadata_confirmed THEN 'confirmed' ELSE 'unconfirmed' END AS metadata", "CASE WHEN facts > 0 AND verified = facts THEN 'verified' ELSE 'unverified' END AS status",
    )


PARSER_REFUSED = "the parser refused this cell rather than guess"


def raw_facts(reviewed: DataFrame) -> DataFrame:
    """Every printed figure beside what was read and decided; a correction never replaces the printed text."""
    return reviewed.select(
        F.col("document_id").alias("company_id"), "fact_id", "page", F.col("raw_label").alias("label"), F.col("raw_value").alias("raw"), F.col("period_label").alias("period"), F.col("parsed.value").alias("value"),
        F.when(F.col("parsed.value").isNull(), PARSER_REFUSED).alias("missing"), "confidence", F.array_join("failed_evidence", ", ").alias("evidence_lacking"), "status",
        F.coalesce("action", F.lit("(not reviewed)")).alias("decision"), F.coalesce("reason", F.lit("")).alias("reason"),
    )


def mapping(mappings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Which line each printed figure became, how, and whether that was approved."""
    m = mappings.join(reviewed.select("document_id", "fact_id", "raw_label"), ["document_id", "fact_id"])
    return m.selectExpr("document_id AS company_id", "fact_id", "raw_label AS label", "account", "mapping_type", "sign", "allocation", "version", "CASE WHEN approved THEN 'approved' ELSE '(not approved)' END AS approval")


def schedules(m) -> DataFrame:
    """Every schedule line of every year."""
    s = H.schedule_set(m.filled)
    return s.withColumn("reason", F.when(F.col("value").isNull(), NOT_COMPUTABLE))


def assumptions(m) -> DataFrame:
    """Resolved value of every driver and year with the scenario that supplies it."""
    return m.resolved.select(*K, "year", "code", "value", "unit", "status", "source_type", "supplied_by", (F.col("supplied_by") != F.col("scenario_id")).alias("inherited"))


def forecast_statement(m, statement: str) -> DataFrame:
    """Actual years (scenario 'reported') and forecast years of a statement, labelled A and E."""
    actual = L.to_long(m.filled).where(F.col("statement") == statement).selectExpr("company_id", "'reported' AS scenario_id", "account", "year", "concat(year, 'A') AS label", "value")
    estimate = FC.to_long(m.forecast).where(F.col("statement") == statement).selectExpr(*K, "account", "year", "concat(year, 'E') AS label", "value")
    return actual.unionByName(estimate)


def dcf(m) -> DataFrame:
    """Rates, yearly present values, terminal value and the way to value per share."""
    yearly = m.dcf_years().selectExpr(*K, "year", stacked([("'fcff'", f"CAST(fcff AS {MONEY})"), ("'present_value'", f"CAST(present_value AS {MONEY})")], ("line", "value")))
    names = ("cost_of_equity", "after_tax_debt", "wacc", "pv_explicit", "terminal_value", "pv_terminal", "enterprise_value", "equity_value", "per_share")
    single = m.valuation.selectExpr(*K, "CAST(NULL AS INT) AS year", stacked([(f"'{n}'", f"CAST({n} AS {MONEY})") for n in names], ("line", "value")))
    return yearly.unionByName(single).where("value IS NOT NULL")


def checks(panel: DataFrame) -> DataFrame:
    """All registered checks with what they compare, status, severity, what stopped them and detail (E11), from a panel."""
    return panel.select(*K, "code", "clause", "compares", "status", "severity", "stage", "blocked_by", "detail")


def limitations(m) -> DataFrame:
    """Stages that a scenario does not reach, with the reason."""
    return m.status.selectExpr(
        *K, "inline(array_compact(array(CASE WHEN NOT may_calculate THEN named_struct('stage', 'forecast', 'reason', split(blocked_by, ':')[0]) END,"
        " CASE WHEN size(missing_inputs) > 0 THEN named_struct('stage', 'valuation', 'reason', concat('missing: ', array_join(missing_inputs, ', '))) END)))")


def export_set(m, evidence: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables by name; the checks of the sources need the filing's evidence (see `panel.filing_evidence`)."""
    short = {"income": "is", "balance": "bs", "cashflow": "cf"}
    out = {"cover": cover(m), "schedules": schedules(m), "assumptions": assumptions(m), "dcf": dcf(m), "limitations": limitations(m), "checks": checks(PN.evaluate(m, evidence))}
    for statement, n in short.items():
        out[f"historical_{n}"] = PF.statement_rows(m.filled, statement)
        out[f"forecast_{n}"] = forecast_statement(m, statement)
    return out
