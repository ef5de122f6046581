"""Streaming forms of filing intake and audit jobs.

The keyed jobs put events in order before they judge them: an event waits in state until the stream has moved past it by the
stated delay, so the result doesn't depend on how arrivals fall into batches. Events that come later than that are returned as late and
change nothing, up to `grace` behind; older ones Spark drops and counts. State of a key goes when the stream is `idle` past its last event.
They need the RocksDB state store: call `use_state_store` once per session.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import dims
from ..operators import facts as FA


CHUNK = 1000  # events in one element of a key's waiting list


def use_state_store(spark: SparkSession) -> None:
    """The keyed jobs keep lists and timers, which the default store can't hold."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def dedupe(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """First upload of each hash per company within the watermark (ST01)."""
    return uploads.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(["company_id", "hash"])


def intake(uploads: DataFrame, root: str, checkpoint: str):
    """Uploads against a registry of every hash ever taken (ST01). The caller starts it.

    uploads: company_id, hash, file_id, uploaded_at. Under `root`: registry (accepted hashes) and refused. A batch owns the folder
    of its run and number and replaces it, and leaves its own folder out of the comparison, so a replayed batch adds nothing; a stream
    begun anew with another checkpoint is another run and sees all that earlier runs took."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    registry = "company_id long, hash string, file_id long, uploaded_at timestamp, prefix string, run string, batch long"

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("company_id", "hash", "file_id", "uploaded_at").withColumn("prefix", F.substring("hash", 1, 2)).persist()
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/registry")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            prefixes = [r.prefix for r in batch.select("prefix").distinct().collect()]  # 256 at most
            known = spark.read.schema(registry).parquet(f"{root}/registry").where(F.col("prefix").isin(prefixes)).where(~((F.col("run") == run) & (F.col("batch") == number)))
        else:
            known = spark.createDataFrame([], registry)
        first = batch.groupBy("company_id", "hash").agg(F.min_by("file_id", F.struct("uploaded_at", "file_id")).alias("first_id"))
        new = first.join(known.select("company_id", "hash").distinct(), ["company_id", "hash"], "left_anti")
        said = batch.join(new, ["company_id", "hash"], "left").withColumn("accepted", F.coalesce(F.col("file_id") == F.col("first_id"), F.lit(False)))
        said = said.persist()
        said.where("NOT accepted").select("company_id", "hash", "file_id").write.mode("overwrite").parquet(f"{root}/refused/run={run}/batch={number}")
        out = said.where("accepted").select("company_id", "hash", "file_id", "uploaded_at", "prefix", F.lit(run).alias("run"), F.lit(number).alias("batch"))
        # the prefix first, so that a batch reads the hashes that can match its own
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "run", "batch").parquet(f"{root}/registry")
        said.unpersist()
        batch.unpersist()

    return uploads.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def audit_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per actor, action and tumbling window (ST04)."""
    return (
        events.withWatermark("at", delay).groupBy(F.window("at", window), "actor", "action")
        .agg(F.count("*").alias("events"), F.max("at").alias("latest"))
        .select(F.col("window.start").alias("window_start"), "actor", "action", "events", "latest")
    )


def _in_order(step: Callable, kept: str, body: str, names: list[str], grace_ms: int, idle_ms: int) -> StatefulProcessor:
    """A processor that gives step(key, kept tuple or None, at in microseconds, event_id, body) each event once, in (at, event_id) order, and
    takes (kept tuple, output fields after the key) from it. `late` rows get no step.

    A call to the state store costs far more than an event, so events are held in chunks, and a key has a timer for the earliest event that
    waits, not one for each: when it goes off, everything that is ready is judged, and the next timer is that of the earliest left."""

    output = Row(*names)

    def chunked(rows: list) -> list:
        return [tuple(list(c) for c in zip(*rows[i : i + CHUNK])) for i in range(0, len(rows), CHUNK)]

    class InOrder(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", f"at array<bigint>, event_id array<bigint>, body array<{body}>")
            self.last = handle.getValueState("last", f"at bigint, {kept}")

        def alarm(self, at: int, more_ms: int = 0) -> None:
            self.handle.registerTimer(-(-at // 1000) + more_ms - grace_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            passed = (timerValues.getCurrentWatermarkInMs() + grace_ms) * 1000
            held, first = [], None
            for r in rows:
                if r.at_us <= passed:
                    yield output(key[0], r.event_id, "late", None)
                    continue
                held.append((r.at_us, r.event_id, r.body))
                first = r.at_us if first is None else min(first, r.at_us)
                if len(held) == CHUNK:
                    self.waiting.appendList(chunked(held))
                    held = []
            if held:
                self.waiting.appendList(chunked(held))
            if first is not None:
                self.alarm(first)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            passed = (timerValues.getCurrentWatermarkInMs() + grace_ms) * 1000
            if self.waiting.exists():
                rows = sorted(r for chunk in self.waiting.get() for r in zip(*chunk))
                n = bisect_right(rows, passed, key=lambda r: r[0])
                if n:
                    state = tuple(self.last.get())[1:] if self.last.exists() else None
                    for at, event_id, what in rows[:n]:
                        state, said = step(state, at, what)
                        if said is not None:
                            yield output(key[0], event_id, *said)
                    self.last.update((rows[n - 1][0], *state))
                    self.alarm(rows[n - 1][0], idle_ms)
                    if n < len(rows):
                        self.waiting.put(chunked(rows[n:]))
                        self.alarm(rows[n][0])
                    else:
                        self.waiting.clear()
            elif self.last.exists() and self.last.get()[0] + idle_ms * 1000 <= passed:
                self.last.clear()

        def close(self) -> None:
            pass

    return InOrder()


def _keyed(events: DataFrame, key: str, body: str, step: Callable, kept: str, kind: str, output: str, delay_s: int, grace_s: int, idle_s: int) -> DataFrame:
    e = events.select(F.col(key).alias("key"), "event_id", F.unix_micros("at").alias("at_us"), F.expr(body).alias("body"), "at").withWatermark("at", f"{delay_s + grace_s} seconds")
    return e.groupBy("key").transformWithState(_in_order(step, kept, kind, [c.split()[0] for c in output.split(", ")], grace_s * 1000, idle_s * 1000), output, "append", "EventTime")


def illegal_transitions(events: DataFrame, edges=dims.ASSUMPTION_EDGES, delay_s: int = 600, grace_s: int = 86_400, idle_s: int = 30 * 86_400) -> DataFrame:
    """State changes along no allowed edge (ST02): key, event_id, state, previous; a late event has the state 'late'.

    events: entity_id STRING, event_id BIGINT, at TIMESTAMP, state STRING. Only each entity's last state and the events of the delay
    are kept. An entity idle for `idle_s` starts anew."""
    allowed = set(edges)

    def step(last, at, state):
        previous = last[0] if last else None
        return (state,), (state, previous) if previous is not None and (previous, state) not in allowed else None

    return _keyed(events, "entity_id", "state", step, "state string", "string", "entity_id string, event_id bigint, state string, previous string", delay_s, grace_s, idle_s)


def rate_limit(events: DataFrame, allowed: int, window_seconds: int, delay_s: int = 60, grace_s: int = 86_400) -> DataFrame:
    """Accepted-only trailing-window limiter (ST03): key, event_id, verdict (accepted, refused or late), in_window (accepted events before it).

    events: key STRING, event_id BIGINT, at TIMESTAMP. A key holds the accepted times of its window, `allowed` at most, and goes
    when the window has passed."""
    width = window_seconds * 1_000_000

    def step(last, at, _):
        live = [t for t in (last[0] if last else ()) if t > at - width]
        ok = len(live) < allowed
        return (live + [at] if ok else live,), ("accepted" if ok else "refused", len(live))

    return _keyed(events, "key", "CAST(NULL AS STRING)", step, "live array<bigint>", "string", "key string, event_id bigint, verdict string, in_window bigint", delay_s, grace_s, window_seconds)


def facts(cells: DataFrame, documents: DataFrame, sink: str, checkpoint: str):
    """Cells arriving as whole tables become facts, batch by batch (ST05). The caller starts it.

    A batch owns the folder of its id and replaces it, so a retried batch adds nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        FA.build_facts(batch, documents).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
