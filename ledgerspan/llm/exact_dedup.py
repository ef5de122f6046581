"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest (partial
aggregation, so a text that fills a third of the batch costs one row per task), deduplicated against
the index by a sort-merge anti-join that reads the index without a shuffle, and appended.

Defined results: a null text counts as empty; all empty texts are equal. Of equal texts in a batch the
row with the largest doc_id stays (null ids lose to any id); of texts already in the index the indexed
row stays. Rows that repeat doc_id and text are one document and get the same answer; `deduplicate`
returns one of them. An empty table gives an empty result. Columns other than doc_id and text are
neither read nor confused with the operator's own.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import lowered, stage, stage_path, with_group


class DigestIndex:
    """A bucketed, sorted table digest -> keep_id at `path`, kept between sessions.

    `buckets` is fixed when the index is created; opening an existing one reads it back. Size it so that
    a bucket fits a task; by default it follows the session's shuffle partitions.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.table = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        try:
            self.buckets = spark.read.schema("buckets int").parquet(f"{path}/spec").first()[0]
        except (AnalysisException, TypeError):
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1, numPartitions=1).select(F.lit(self.buckets).cast("int").alias("buckets")).write.mode("overwrite").parquet(f"{path}/spec")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/index'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """Add the digests that the index lacks. A repeated call adds nothing."""
        known = self.entries().hint("merge")
        fresh = groups.join(known, "digest", "left_anti").select("digest", F.col("doc_id").alias("keep_id"))
        fresh.write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each text with A-Z lowered, as 32 bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(lowered(F.col("text")).cast("binary"), 256)).alias("digest"))


def classify(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size (equal rows in this batch), kept, text_sha256 of every row; the batch is indexed."""
    rows = stage(digests(docs), "digests")
    groups = stage(rows.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    index.append(groups)
    indexed = groups.drop("doc_id").join(index.entries().hint("merge"), "digest")
    out = with_group(rows, indexed, "digest", "group_size")
    return out.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    return DigestIndex(spark, stage_path(spark, "digest-index"), buckets)


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = classify(docs, index).filter("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest")).distinct()
    own = docs.select("*", F.unhex(F.sha2(lowered(F.col("text")).cast("binary"), 256)).alias("_own_digest"))
    cond = own["doc_id"].eqNullSafe(kept["_id"]) & (own["_own_digest"] == kept["_digest"])
    return own.join(kept, cond, "left_semi").dropDuplicates(["doc_id", "_own_digest"]).drop("_own_digest")


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
