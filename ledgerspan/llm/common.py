"""What the operators of this subpackage share: stage tables on shared storage and word rules."""

from __future__ import annotations

import os
import uuid
from pathlib import Path
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerspan.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of bytes other than space and the five control white spaces.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster, ship it with --py-files),
    and keep what passes between them and the JVM small."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's default, made for short rows; texts are long
        spark.conf.set(BATCH_ROWS, "1000")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder of the session."""
    importable(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it back: later steps, and retries after a lost
    executor, start from files instead of replaying the plan. The folder is the caller's to clear."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.reverse(text))


def keep_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key, null included, occurs in ids."""
    ids = ids.select(F.col(key).alias("_kept_id")).distinct()
    return docs.join(ids, docs[key].eqNullSafe(ids["_kept_id"]), "left_semi")


def drop_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key, null included, does not occur in ids."""
    ids = ids.select(F.col(key).alias("_dropped_id")).distinct()
    return docs.join(ids, docs[key].eqNullSafe(ids["_dropped_id"]), "left_anti")


#: A group with this share of the rows or more is joined by broadcast; so there are at most 1 / share of them.
HOT_SHARE = 0.001


def with_group(rows: DataFrame, groups: DataFrame, key: str, copies: str) -> DataFrame:
    """Inner join of staged rows with one row per key. `copies` counts the rows of the key, so the keys that
    hold HOT_SHARE of all rows are few whatever the data: they join by broadcast, the others by sort-merge."""
    least = max(2, int(rows.count() * HOT_SHARE) + 1)
    hot, cold = groups.filter(F.col(copies) >= least), groups.filter(F.col(copies) < least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
