"""Registered queries: the streaming jobs over the given tables, replayed as files that arrive one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..session import stage_root
from ..sources import derived as D
from ..sources import filings as FL
from ..streaming import streams as ST
from . import q_filing  # noqa: F401  (its common table expressions)
from .duck import sql, values
from .q_filing import _BLOCKING
from .q_text import _EV, _ST
from .registry import dbl, register, sd

#: Files come in any order, so the delay spans the whole table; one closing event far behind it lets everything pass.
DELAY_S, GRACE_S = 400 * 86_400 * 10, 3600
CLOSING = "'closing'"


def arriving(rows: DataFrame, files: int = 4) -> DataFrame:
    """The rows as a stream of files."""
    spark, path = rows.sparkSession, stage_root(rows.sparkSession)
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def with_closing(rows: DataFrame, closing: DataFrame, files: int = 4) -> DataFrame:
    """The same, and behind all of it one file with the closing row."""
    spark, path = rows.sparkSession, stage_root(rows.sparkSession)
    rows.repartition(files).write.parquet(path)
    closing.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream has written when its input is used up."""
    spark, path = stream.sparkSession, stage_root(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", stage_root(spark)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _closing(events: DataFrame, **columns: str) -> DataFrame:
    """One row of the events' columns, later than all of them by delay and grace."""
    last = events.agg(F.max("at").alias("at"), F.max("event_id").alias("event_id"))
    return last.selectExpr(*[f"{columns[c]} AS {c}" if c in columns else f"at + INTERVAL {DELAY_S + GRACE_S + 3600} SECONDS AS at" if c == "at" else f"event_id + 1 AS {c}" for c in events.columns])


@register("st02_stream_transitions", f"SELECT entity_id, event_id, state, previous FROM (SELECT *, lag(state) OVER (PARTITION BY entity_id ORDER BY at_ts, event_id) AS previous FROM (SELECT *, {_ST} AS state FROM ({_EV}))) s WHERE previous IS NOT NULL"
          f" AND NOT EXISTS (SELECT 1 FROM ({values(dims.ASSUMPTION_EDGES, 'previous, state', 'ed')}) e WHERE e.previous = s.previous AND e.state = s.state)")
def st02(spark, sf):
    """The state machine as a stream: the same illegal moves as over the sorted table."""
    ST.use_state_store(spark)
    e = D.audit_events(spark, sf).selectExpr("entity_id", "event_id", "CAST(at AS TIMESTAMP) AS at", f"{_ST} AS state")
    moves = ST.illegal_transitions(with_closing(e, _closing(e, entity_id=CLOSING, state="'Draft'")), delay_s=DELAY_S, grace_s=GRACE_S, idle_s=100 * DELAY_S)
    return drained(moves).select("entity_id", "event_id", "state", "previous")


@register("st03_stream_rate_limit")
def st03(spark, sf):
    """Five accepted events per actor and day; the rest refused."""
    ST.use_state_store(spark)
    e = D.audit_events(spark, sf).selectExpr("actor AS key", "event_id", "CAST(at AS TIMESTAMP) AS at")
    return drained(ST.rate_limit(with_closing(e, _closing(e, key=CLOSING)), 5, 86_400, delay_s=DELAY_S, grace_s=GRACE_S)).where(f"key <> {CLOSING}")


@register("st04_stream_audit_counts", f"SELECT epoch(time_bucket(INTERVAL 1 HOUR, at_ts)) AS window_start, actor, action, CAST(count(*) AS BIGINT) AS events FROM ({_EV}) GROUP BY 1, 2, 3")
def st04(spark, sf):
    e = D.audit_events(spark, sf).selectExpr("actor", "action", "CAST(at AS TIMESTAMP) AS at", "event_id")
    counts = ST.audit_counts(with_closing(e, _closing(e, actor=CLOSING, action=CLOSING)), delay=f"{DELAY_S} seconds")
    return drained(counts).where(f"actor <> {CLOSING}").select(F.unix_timestamp("window_start").cast("double").alias("window_start"), "actor", "action", "events")


@register("st01_stream_registry", "SELECT CAST(page_id % 10 AS BIGINT) AS company_id, sha256(html) AS hash, CAST(min(page_id) AS BIGINT) AS file_id FROM pages GROUP BY 1, 2")
def st01(spark, sf):
    """Uploads, and a third of them once more in a later run: the registry holds each hash of a company once, with the earliest file."""
    root = stage_root(spark)
    p = D.table(spark, sf, "pages").selectExpr("page_id % 10 AS company_id", "sha2(html, 256) AS hash", "page_id AS file_id", "timestamp_seconds(page_id) AS uploaded_at")
    for i, rows in enumerate((p, p.where("file_id % 3 = 0").withColumn("file_id", -F.col("file_id") - 1))):
        stream = arriving(rows, 1)
        ST.intake(stream, root, f"{root}/checkpoint-{i}").start().awaitTermination()
    return spark.read.parquet(f"{root}/registry").select("company_id", "hash", "file_id")


@register("st05_stream_facts", sql("SELECT document_id, fact_id, raw_label, period_label, " + sd("parsed", "value") + ", codes, " + _BLOCKING + " OR confidence < 0.875 AS needs_review FROM ffacts", "ffacts"))
def st05(spark, sf):
    """Cells that arrive document by document become the facts of the batch job."""
    out, cells = stage_root(spark), FL.raw_cells(spark, sf)
    path = stage_root(spark)
    cells.repartition("document_id").write.parquet(path)  # whole tables per file
    ST.facts(spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 2).parquet(path), FL.documents(spark, sf), out, stage_root(spark)).start().awaitTermination()
    f = spark.read.parquet(out)
    return f.select("document_id", "fact_id", "raw_label", "period_label", dbl("parsed.value").alias("value"), F.array_join("reason_codes", ",").alias("codes"), "needs_review")
