"""Review as a replay of append-only decision tables over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..layers import spread
from .facts import effective_value, outstanding

DOCUMENT_CODES = ("SCALE_UNCONFIRMED", "CURRENCY_UNCONFIRMED")


def latest_decision(decisions: DataFrame) -> DataFrame:
    """Last decision per fact in (at, event_id) order."""
    return spread(decisions, "document_id").groupBy("document_id", "fact_id").agg(
        F.max_by(F.struct("action", "actor", "reason", "corrected_value"), F.struct("at", "event_id")).alias("d")
    ).select("document_id", "fact_id", "d.*")


def decision_violations(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """Decisions without a reason, and acceptances of a fact with no value or an unconfirmed document."""
    d = decisions.join(facts.select("document_id", "fact_id", "parsed", "reason_codes"), ["document_id", "fact_id"])
    return d.withColumn(
        "problem",
        F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason")
        .when((F.col("action") == "accept") & F.col("parsed.value").isNull(), "no value to accept")
        .when((F.col("action") == "accept") & F.arrays_overlap("reason_codes", F.array(*map(F.lit, DOCUMENT_CODES))), "document not confirmed")
        .when((F.col("action") == "correct") & F.col("corrected_value").isNull(), "no corrected value"),
    ).where("problem IS NOT NULL")


def apply_decisions(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts with status, correction and the fact-level codes the decision resolves."""
    d = latest_decision(decisions)
    f = facts.drop("corrected_value").join(d, ["document_id", "fact_id"], "left")
    f = f.withColumns(
        {
            "status": F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "correct", "corrected").when(F.col("action") == "reject", "rejected").otherwise("unreviewed"),
            "corrected_value": F.when(F.col("action") == "correct", F.col("corrected_value")),
            "resolved_codes": F.when(
                F.col("action").isin("accept", "correct"),
                F.array_except(F.array_intersect("reason_codes", F.array(*map(F.lit, dims.BLOCKING))), F.array(*map(F.lit, DOCUMENT_CODES))),
            ).otherwise(F.array().cast("array<string>")),
        }
    )
    return f.withColumns({"value": effective_value(), "outstanding": outstanding()})


def confirmed_fields(confirmations: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Latest confirmation per field and whether every required one is confirmed.

    confirmations: document_id, field, value, at, event_id, state."""
    latest = confirmations.groupBy("document_id", "field").agg(F.max_by(F.struct("value", "state"), F.struct("at", "event_id")).alias("f"))
    ok = F.collect_set(F.when(F.col("f.state").isin("confirmed", "corrected"), F.col("field")))
    need = F.array(*map(F.lit, required))
    return latest.groupBy("document_id").agg(ok.alias("confirmed")).select(
        "document_id", F.array_sort(F.array_except(need, "confirmed")).alias("unconfirmed"), (F.size(F.array_except(need, "confirmed")) == 0).alias("metadata_confirmed")
    )


def gates(reviewed: DataFrame, mapping_state: DataFrame, documents: DataFrame) -> DataFrame:
    """Seven conditions per fact; six make a review complete, all seven make it verified."""
    f = reviewed.join(mapping_state, ["document_id", "fact_id"], "left").join(documents.select("document_id", "metadata_confirmed"), "document_id", "left")
    recon = F.array(F.lit("SUBTOTAL_MISMATCH"), F.lit("CROSS_STATEMENT_MISMATCH"))
    g = f.withColumns(
        {
            "g1_located": F.coalesce(F.col("page") >= 1, F.lit(False)),
            "g2_raw_kept": F.col("raw_value").isNotNull(),
            "g3_metadata": F.coalesce("metadata_confirmed", F.lit(False)),
            "g4_no_blocking": F.size("outstanding") == 0,
            "g5_reconciles": ~F.arrays_overlap("outstanding", recon),
            "g6_decided": F.col("status").isin("accepted", "corrected"),
            "g7_mapping": F.coalesce("mapping_approved", F.lit(False)),
        }
    )
    six = F.col("g1_located") & F.col("g2_raw_kept") & F.col("g3_metadata") & F.col("g4_no_blocking") & F.col("g5_reconciles") & F.col("g6_decided")
    return g.withColumns({"review_complete": six, "verified": six & F.col("g7_mapping"), "excluded": F.coalesce("excluded", F.lit(False)), "unmapped": F.col("mapping_approved").isNull()})


def progress(gated: DataFrame, *by: str) -> DataFrame:
    """Review counts per document, or per page."""
    s = F.col("status")
    decided = s.isin("accepted", "corrected", "rejected")
    return gated.groupBy("document_id", *by).agg(
        F.count("*").alias("total"),
        F.count_if(decided).alias("decided"),
        F.count_if(s == "accepted").alias("accepted"),
        F.count_if(s == "corrected").alias("corrected"),
        F.count_if(s == "rejected").alias("rejected"),
        F.count_if(F.size("outstanding") > 0).alias("unresolved"),
        F.count_if("review_complete").alias("review_complete"),
        F.count_if("verified").alias("verified"),
        F.count_if(F.coalesce("mapping_approved", F.lit(False))).alias("mapped_and_approved"),
        F.count_if("excluded").alias("excluded"),
        F.count_if("unmapped").alias("unmapped"),
        F.floor(F.count_if(decided) * 100 / F.count("*")).alias("percent_decided"),
    )


def revise(before: DataFrame, after: DataFrame) -> DataFrame:
    """Decisions after a re-parse: an acceptance of a value that changed is withdrawn."""
    b = before.select("document_id", "fact_id", "status", F.col("parsed.value").alias("old_value"))
    a = after.select("document_id", "fact_id", F.col("parsed.value").alias("new_value"))
    changed = ~F.col("old_value").eqNullSafe(F.col("new_value"))
    return b.join(a, ["document_id", "fact_id"]).withColumn("status_after", F.when(changed & (F.col("status") == "accepted"), "unreviewed").otherwise(F.col("status")))
