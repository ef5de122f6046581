"""Audit log, rate audit, ordered state histories, fingerprints. Hot keys are split by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import dims


def filter_events(events: DataFrame, actor=None, action=None, entity_type=None, entity_id=None, since=None, until=None, text=None) -> DataFrame:
    """Composable predicates; each that is given reaches the scan (P30). Order newest first with newest_first()."""
    out, kind = events, events.schema["at"].dataType
    for col, v in (("actor", actor), ("action", action), ("entity_type", entity_type), ("entity_id", entity_id)):
        if v is not None:
            out = out.where(F.col(col) == v)
    if since is not None:
        out = out.where(F.col("at") >= F.lit(since).cast(kind))
    if until is not None:
        out = out.where(F.col("at") <= F.lit(until).cast(kind))
    if text is not None:
        out = out.where(F.contains(F.lower("entity_id"), F.lit(text.lower())))
    return out


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("at"), F.desc("event_id"))


def summary(events: DataFrame) -> DataFrame:
    """Events and the latest one per (actor, action) (A10)."""
    return events.groupBy("actor", "action").agg(F.count("*").alias("events"), F.max("at").alias("latest"))


def choices(events: DataFrame) -> DataFrame:
    """Distinct values a filter may take, one row each, so nothing is collected in one place."""
    return events.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("actor", "action", "entity_type")])).alias("c")).select("c.*").distinct()


def previous_in_order(events: DataFrame, key: str, value: str, order: Sequence[str], bucket: Column) -> DataFrame:
    """The preceding value per key, exact, with hot keys split into time buckets.

    Inside a bucket it is a lag; the first row of a bucket takes the last value of the key's previous
    bucket, found over one small row per key and bucket."""
    e = events.withColumn("_bucket", bucket)
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    e = e.withColumns({"_lag": F.lag(value).over(w), "_rn": F.row_number().over(w)})
    last = e.groupBy(key, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket"))).drop("_last")
    return e.join(last, [key, "_bucket"]).withColumn("previous", F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_lag"))).drop("_bucket", "_lag", "_rn", "_before")


def illegal_transitions(events: DataFrame, edges, bucket: Column) -> DataFrame:
    """State changes along no allowed edge (W15). events: entity_id, event_id, at, state."""
    p = previous_in_order(events, "entity_id", "state", ("at", "event_id"), bucket).where("previous IS NOT NULL")
    allowed = F.broadcast(dims.local_table(events.sparkSession, list(edges), "previous string, state string"))
    return p.join(allowed, ["previous", "state"], "left_anti")


def rate_burst(events: DataFrame, key: str, window_seconds: int, allowed: int) -> DataFrame:
    """Events whose trailing window (open at its far end) holds more than the allowed number.

    Each event is also shown to the next bucket as context, so a bucket as long as the window sees
    its whole trailing window and a hot key spreads over its buckets."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    width = window_seconds * 1_000_000
    e = events.withColumns({"_us": micros, "_own": F.floor(micros / width)})
    both = e.withColumn("_bucket", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-(width - 1), 0)
    return (
        both.withColumn("in_window", F.count("*").over(w)).where(F.col("_own") == F.col("_bucket"))
        .withColumn("over_limit", F.col("in_window") > allowed).drop("_us", "_own", "_bucket")
    )


def digested(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts, so that no two lists of parts read alike."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(p), F.lit(":"), p) for p in parts]), 256)


def digest_tree(rows: DataFrame, keys: Sequence[str], part: Column) -> DataFrame:
    """fingerprint per key of a multiset of texts, the same for any order and partitioning.

    Leaves are SHA-256 digests of the texts. A node holds the digests that begin with the same byte, as their number and the sums of
    their eight 32-bit words: it is added up where the rows are and keeps its size whatever it holds. The root digests the
    nodes of a key, 256 at most, in order. No list of rows is gathered, so a key may hold any share of them."""
    leaf = rows.select(*keys, digested(part).alias("_leaf")).withColumn("_node", F.substring("_leaf", 1, 2))
    words = {f"_w{i}": F.sum(F.conv(F.substring("_leaf", i, 8), 16, 10).cast("long")) for i in range(1, 65, 8)}
    nodes = leaf.groupBy(*keys, "_node").agg(F.count(F.lit(1)).alias("_n"), *[s.alias(n) for n, s in words.items()])
    text = F.concat_ws(",", "_node", "_n", *words)
    return nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(text)).alias("_nodes")).select(*keys, F.sha2(F.array_join("_nodes", ";"), 256).alias("fingerprint"))


def fingerprint(rows: DataFrame, keys: Sequence[str], part: Column) -> DataFrame:
    """Order-free digest per key."""
    return digest_tree(rows, keys, part)


VERSION_SCHEME = "2"


def model_version(documents: DataFrame, mappings: DataFrame, resolved: DataFrame, scenarios: DataFrame) -> DataFrame:
    """company_id, scenario_id, version: changes when the document, a mapping that moves a figure, a resolved assumption or the scenario does.

    documents: document_id, hash. mappings: the current ones, with approved. resolved: every scenario's rows for no period and per year."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    of_map = digest_tree(
        mappings, ["document_id"], F.concat_ws("|", "fact_id", "account", "mapping_type", text("allocation"), "sign", F.when(F.col("approved"), "approved").otherwise("unapproved"))
    ).select(F.col("document_id").alias("company_id"), F.col("fingerprint").alias("mapping"))
    of_assumptions = digest_tree(resolved, ["company_id", "scenario_id"], F.concat("code", F.lit("@"), "year", F.lit("="), text("value"), F.lit(":"), "status")).withColumnRenamed("fingerprint", "assumptions")
    rows = scenarios.select("company_id", "scenario_id").join(documents.select(F.col("document_id").alias("company_id"), "hash"), "company_id", "left")
    rows = rows.join(of_map, "company_id", "left").join(of_assumptions, ["company_id", "scenario_id"], "left")
    named = {"scheme": F.lit(VERSION_SCHEME), "document": F.coalesce("hash", F.lit("none")), "mapping": F.coalesce("mapping", F.lit("none")), "scenario": F.col("scenario_id"), "assumptions": F.coalesce("assumptions", F.lit("none"))}
    return rows.select("company_id", "scenario_id", digested(*[F.concat(F.lit(f"{n}="), c) for n, c in named.items()]).alias("version"))


def changed_from_previous(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets whose value differs between two runs, null-safe."""
    j = old.select(*keys, F.col("value").alias("before")).join(new.select(*keys, F.col("value").alias("after")), list(keys), "full_outer")
    return j.where(~F.col("before").eqNullSafe(F.col("after")))


def report_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = 24) -> DataFrame:
    """The first rows of each report table with the total beside them.

    The rank alone is limited before the shuffle, and the total is a partial count, so a hot key
    never gathers in one task."""
    first = rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= limit)
    return first.join(rows.groupBy(*keys).agg(F.count("*").alias("total")), list(keys))
