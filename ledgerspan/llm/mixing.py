"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents are taken in key order until the
source's word budget is met; a budget above the source's size repeats whole epochs first. Budgets:
sources in code-point order (null last) share all words by weights 5, 2, 1, repeating; none gets more
than three times its size, and what it leaves is shared again by weight.

The order within a source is a prefix sum over two levels: about sqrt(rows) ranges of the key space are
summed first (they are ranges of a uniform hash, so a source with a third of all rows is cut evenly), then
rows are summed inside their range. No task sees a whole source.

Defined results: a null text has no words and is never taken as such; a null source is a source of its own,
last in order; a null doc_id hashes as an empty string. Ties of key (repeated rows) are ordered by doc_id,
size and a hash of the text. doc_id need not be unique: rows without one, or that share one, are taken and copied
each by its own share; of rows equal in doc_id, source and text, which one gets the odd copy is open. If there are no words at all, every target is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage, text_hashes, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def random_key(doc_id: Column, seed: str = "mix") -> Column:
    """60 random bits that depend on doc_id and the seed only, so reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _rank(df: DataFrame, by: Column, parts: int) -> DataFrame:
    """Global rank from 0: range parts are ranked apart and shifted by the rows before them."""
    ranged = stage(df.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()), "ranked")
    before = ranged.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return ranged.join(F.broadcast(before.drop("count")), "_part").withColumn("_rank", own - 1 + F.col("_before")).drop("_part", "_before")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, parts: int = 8) -> DataFrame:
    """source, source_size -> the same with target. Only sums of the table reach the driver."""
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    table = stage(
        _rank(sizes, F.col("source").asc_nulls_last(), parts)
        .select("source", "source_size", cycle.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")),
        "sources",
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rest, weight, full = total, 0, -1
    while True:  # fills further sources each time; ends when no more reach their cap
        above = F.lit(False) if full < 0 else F.col("cap") <= F.lit(rest) * F.col("weight") / F.lit(max(weight, 1))
        n, cap, w = table.agg(
            F.coalesce(F.sum(above.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or w == 0:
            break
        rest, weight, full = total - cap, w, n
    share = F.lit(rest).cast("long") * F.col("weight") / F.lit(max(weight, 1))
    return table.select("source", "source_size", F.least(F.col("cap").cast("double"), share.cast("double")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole repeats), part (words of the last, partial epoch), taken,
    hash and hash2 (of the text, which with doc_id and source finds the row again)."""
    spark = docs.sparkSession
    hash_, hash2 = text_hashes(F.col("text"))
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"), hash_.alias("hash"), hash2.alias("hash2")), "mix-rows")
    ranges = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("range", F.shiftright(F.shiftright("key", 30) * F.lit(ranges).cast("long"), 30))
    sums = stage(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    by_source = sums.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    goal = targets(by_source, weights, max_epochs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    ranged = sums.withColumn("range_before", before).withColumnsRenamed({"source": "s", "range": "r"})
    goal = goal.withColumnRenamed("source", "g")
    ranged = ranged.join(goal, ranged["s"].eqNullSafe(goal["g"])).drop("g", "range_size")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "hash", "hash2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    joined = own.join(ranged, own["source"].eqNullSafe(ranged["s"]) & (own["range"] == ranged["r"]))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    out = joined.withColumn("epochs", epochs).withColumn("start", F.col("range_before") + F.col("inside"))
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), budget - F.col("epochs") * F.col("source_size") - F.col("start")))
    return out.withColumn("part", part).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("size") * F.col("epochs") + F.col("part")).alias("taken"), "hash", "hash2"
    )


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed documents as rows: one per whole epoch, and one more where the last epoch takes at least half
    of the document's words. All columns of docs are kept. Rows meet their shares by doc_id, source and text;
    the shares of equal rows are summed first, so each row of docs meets one row at most."""
    n = F.col("epochs") + (F.col("part") * 2 >= F.col("size")).cast("long") * (F.col("part") > 0).cast("long")
    names = {"doc_id": "_m_id", "source": "_m_source", "hash": "_m_hash", "hash2": "_m_hash2"}
    shares = mixed.withColumn("_n", n).groupBy(*names).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows")).filter("_n > 0").withColumnsRenamed(names)
    # the same copies for each of the equal rows, and an odd rest; in the order of mix equal rows are neighbours,
    # so only the group at the cut of each source has a rest
    shares = stage(shares.withColumns({"_each": F.expr("_n div _rows"), "_rest": F.expr("_n % _rows")}).drop("_n", "_rows"), "mix-shares")
    hash_, hash2 = text_hashes(docs["text"])

    def met(part: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(part["_m_id"]) & docs["source"].eqNullSafe(part["_m_source"]) & (hash_ == part["_m_hash"]) & (hash2 == part["_m_hash2"])
        return docs.join(part, same)

    place = F.row_number().over(Window.partitionBy("_m_id", "_m_source", "_m_hash", "_m_hash2").orderBy("_m_hash"))
    odd = met(shares.filter("_rest > 0")).withColumn("_copies", F.col("_each") + (place <= F.col("_rest")).cast("long"))
    even = met(shares.filter("_rest = 0")).withColumn("_copies", F.col("_each"))
    copies = F.explode(F.expr("sequence(1, cast(_copies AS int))")).alias("_copy")
    out = [x.filter("_copies > 0").select(*docs.columns, copies).drop("_copy") for x in (even, odd)]
    return out[0].unionByName(out[1])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 3 AS cap,
             [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
l AS (SELECT *, (SELECT CAST(sum(source_size) AS BIGINT) FROM s) - coalesce(CAST(sum(cap) OVER p AS BIGINT), 0) AS rest,
             CAST(sum(weight) OVER q AS BIGINT) AS open_weight FROM w
      WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             q AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lv AS (SELECT rest, open_weight FROM l WHERE cap > rest * weight / open_weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT rest * weight / open_weight FROM lv), 0.0)) AS target FROM w),
e AS (SELECT source, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
             CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
o AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * epochs + least(size, greatest(0, budget - epochs * source_size - start)) AS BIGINT) AS taken FROM o
"""
