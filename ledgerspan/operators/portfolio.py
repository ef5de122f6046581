"""Portfolio views: release readiness, model standing, output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import dims
from .ledger import SLOTS, col_of, stacked

def readiness(panel: DataFrame) -> DataFrame:
    """A scenario is releasable when every actionable clause passes, whatever its severity."""
    open_ = (F.col("status") != "PASS") & ~F.col("clause").isin(*dims.NOT_ACTIONABLE)
    return panel.groupBy("company_id", "scenario_id").agg(
        F.count_if(open_).alias("blocking"), F.count_if(open_ & (F.col("severity") == "CRITICAL")).alias("critical"), (F.count_if(open_) == 0).alias("releasable")
    )


def stage_checklist(panel: DataFrame) -> DataFrame:
    return panel.groupBy("company_id", "scenario_id", "stage").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIP")])


def standing(status: DataFrame) -> DataFrame:
    """Furthest satisfied gate per company on its base scenario, and the first unmet one."""
    b = status.where("scenario_id = 'base'")
    gates = F.array(
        F.struct(F.lit(1).alias("n"), F.lit("opening balances").alias("gate"), (~F.coalesce(F.col("blocked_by").startswith("opening"), F.lit(False))).alias("met")),
        F.struct(F.lit(2).alias("n"), F.lit("required assumptions").alias("gate"), F.col("may_calculate").alias("met")),
        F.struct(F.lit(3).alias("n"), F.lit("cost-of-capital inputs").alias("gate"), (F.size(F.coalesce("missing_inputs", F.array().cast("array<string>"))) == 0).alias("met")),
    )
    unmet = F.filter(gates, lambda g: ~g["met"])
    g = b.withColumn("unmet", unmet)
    return g.select(
        "company_id",
        F.when(F.size("unmet") == 0, "Valuation Ready").when(F.col("unmet")[0]["n"] == 3, "Forecast Ready").when(F.col("unmet")[0]["n"] == 2, "Validated").otherwise("Needs Review").alias("status"),
        F.when(F.size("unmet") > 0, F.col("unmet")[0]["gate"]).otherwise("").alias("next_step"),
    )


def cards(standing_: DataFrame) -> DataFrame:
    """Portfolio totals."""
    return standing_.agg(
        F.count("*").alias("models"), F.count_if(F.col("status") == "Valuation Ready").alias("valuation_ready"), F.count_if(F.col("status") == "Needs Review").alias("needs_review"), F.count_if(F.col("next_step") != "").alias("unresolved")
    )


def ordered(standing_: DataFrame) -> DataFrame:
    """Furthest status first, then company."""
    rank = F.array_position(F.array(*map(F.lit, dims.MODEL_STATUSES)), F.col("status"))
    return standing_.orderBy(F.desc(rank), "company_id")


NOT_REPORTED = "not reported and not derivable"


def statement_rows(filled: DataFrame, statement: str) -> DataFrame:
    """Every line of a statement for every reported year; an absent cell keeps its row and says why."""
    rows = [(f"'{a}'", col_of(s, a), f"CASE WHEN {col_of(s, a)} IS NULL THEN '{NOT_REPORTED}' END") for s, a in SLOTS if s == statement]
    return filled.selectExpr("company_id", "year", stacked(rows, ("account", "value", "reason")))


def statement_table(filled: DataFrame, statement: str, years: tuple[int, ...]) -> DataFrame:
    """Line by year over an axis that the caller states, with absent cells as NULL."""
    from .ledger import to_long

    return to_long(filled).where(F.col("statement") == statement).groupBy("company_id", "account").pivot("year", list(years)).agg(F.first("value"))


def presence_mask(filled: DataFrame) -> DataFrame:
    """How many lines each company-year reports, so a pivot's NULL is not mistaken for a figure."""
    return filled.selectExpr("company_id", "year", " + ".join(f"CAST({col_of(s, a)} IS NOT NULL AS INT)" for s, a in SLOTS) + " AS lines_present")
