"""Handing the reviewed historical half to the model: checked as a whole per company, published whole or not at all.

Phase one writes the candidate rows of every company and a table of what refuses it. Phase two publishes, per company without a
refusal, its profile and its ledger into partitions of its own; nothing of a refused company appears, and a company's
earlier publication is replaced by partition, so readers never see half of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..session import cut_lineage, joins_keep_clustering

BUCKETS = 32
NEEDED_FIELDS = ("displayed_scale", "reporting_currency")


def refusals(evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """company_id, reason: everything that refuses a company.

    evidence: company_id, build_error, scale_confirmed, currency_confirmed. ledger: company_id, year, value."""
    fields = {"displayed_scale": "scale_confirmed", "reporting_currency": "currency_confirmed"}
    said = [F.when(~F.coalesce(c, F.lit(False)), F.lit(f"{n} is not confirmed")) for n, c in ((n, F.col(c)) for n, c in fields.items())]
    rows = evidence.join(ledger.select("company_id").distinct().withColumn("_has", F.lit(True)), "company_id", "left")
    said += [F.when(F.col("_has").isNull(), "no figure to hand over"), F.when(F.col("build_error").isNotNull() & F.col("_has").isNotNull(), F.col("build_error"))]
    return rows.select("company_id", F.explode(F.array_compact(F.array(*said))).alias("reason"))


def profile(evidence: DataFrame, ledger: DataFrame, pages: DataFrame) -> DataFrame:
    """company_id, first_actual, last_actual, first_forecast, gaps: the axis that is handed over and required sections without a page."""
    span = ledger.groupBy("company_id").agg(F.min("year").alias("first_actual"), F.max("year").alias("last_actual"))
    found = pages.groupBy("company_id").agg(F.collect_set("section").alias("found"))
    need = F.array(*map(F.lit, dims.REQUIRED_SECTIONS))
    rows = evidence.select("company_id").join(span, "company_id").join(found, "company_id", "left")
    return rows.select("company_id", "first_actual", "last_actual", (F.col("last_actual") + 1).alias("first_forecast"), F.array_except(need, F.coalesce("found", F.array().cast("array<string>"))).alias("gaps"))


def publish(evidence: DataFrame, ledger: DataFrame, pages: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(published ledger, published profile, refusals) under `root`."""
    spark = ledger.sparkSession

    # both lie clustered on the company: what refuses a company meets its rows without moving them, and the ledger is worked out once
    candidate = cut_lineage(ledger, "company_id", path=f"{root}/candidate")
    no = cut_lineage(refusals(evidence, candidate), "company_id", path=f"{root}/refusals")
    clear = candidate.join(no, "company_id", "left_anti")
    out = []
    for name, rows in (("ledger", clear), ("profile", profile(evidence, candidate, pages).join(no, "company_id", "left_anti"))):
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("company_id"), F.lit(BUCKETS)).cast("int"))
        rows = rows.repartition("bucket") if name == "profile" else rows  # a row per company: else every task writes a file per bucket
        path = f"{root}/published/{name}"
        earlier = _kept(spark, path, candidate.select("company_id").distinct(), rows)
        with joins_keep_clustering(spark):
            (rows if earlier is None else rows.unionByName(earlier)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
        out.append(spark.read.schema(rows.schema).parquet(path).drop("bucket"))
    return out[0], out[1], no


def _kept(spark, path: str, now: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Companies published before that are not in this run and share a partition with it; written aside first, because their partition is replaced."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    if not jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm(path)):
        return None
    before = spark.read.schema(rows.schema).parquet(path).join(now, "company_id", "left_anti").join(rows.select("bucket").distinct(), "bucket", "left_semi").select(rows.columns)
    before.write.mode("overwrite").parquet(f"{path}_kept")
    return spark.read.schema(rows.schema).parquet(f"{path}_kept")
