"""Keyed streams: any batching gives the result of the ordered batch; late events change nothing; idle state goes; the registry outlives a restart."""

import random
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerspan import dims
from ledgerspan.streaming import streams as ST

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def scratch():
    return tempfile.mkdtemp(prefix="spark-")


@pytest.fixture(autouse=True)
def store(spark):
    ST.use_state_store(spark)


def feed(spark, batches, schema):
    """One file per batch, read one at a time in that order."""
    root = scratch() + "/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/b={i:03d}")
    return spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(root)


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch()).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return df.sparkSession.table(name).collect(), [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


def at(seconds):
    return START + timedelta(seconds=seconds)


def limiter(rows, allowed, width):
    live, out = {}, {}
    for key, event, when in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = [t for t in live.get(key, []) if t > when - timedelta(seconds=width)]
        out[event] = "accepted" if len(mine) < allowed else "refused"
        live[key] = mine + [when] if out[event] == "accepted" else mine
    return out


@pytest.mark.parametrize("cuts", [1, 4, 9])
def test_rate_limit_equals_the_batch_limiter_under_any_batching(spark, cuts):
    rng = random.Random(cuts)
    rows = [(f"k{rng.randint(0, 3)}", i, at(rng.randint(0, 300))) for i in range(150)]
    rows.sort(key=lambda r: r[2] + timedelta(seconds=rng.randint(0, 40)))  # arrivals out of order, within the delay
    size = -(-len(rows) // cuts)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)] + [[("end", 10_000, at(5000))], [("end", 10_001, at(10_000))]]
    got, state = drain(ST.rate_limit(feed(spark, batches, "key string, event_id bigint, at timestamp"), 3, 30, delay_s=60, grace_s=3600), f"limited{cuts}")
    assert {r.event_id: r.verdict for r in got if r.event_id < 10_000} == limiter(rows, 3, 30)
    assert state[-1] < max(state)


def test_late_events_make_no_false_illegal_move_and_idle_entities_go(spark):
    schema = "entity_id string, event_id bigint, at timestamp, state string"
    batches = [
        [("a", 1, at(0), "Draft"), ("b", 2, at(1), "Draft")],
        [("a", 4, at(30), "Approved"), ("a", 3, at(20), "Reviewed")],  # in order by time, not by arrival
        [("clock", 90, at(500), "Draft")],
        [("a", 5, at(10), "Needs Source"), ("a", 6, at(600), "Reviewed")],  # 5 is late: by then a is Approved
        [("clock", 91, at(2000), "Reviewed")],
        [("clock", 92, at(40_000), "Approved")],
        [("a", 7, at(40_100), "Approved"), ("clock", 93, at(42_000), "Rejected")],  # a was idle: nothing to compare with
        [("clock", 94, at(44_000), "Draft")],
    ]
    got, state = drain(ST.illegal_transitions(feed(spark, batches, schema), delay_s=60, grace_s=3600, idle_s=10_000), "illegal_late")
    assert {(r.entity_id, r.event_id, r.state, r.previous) for r in got} == {("a", 5, "late", None), ("a", 6, "Reviewed", "Approved")}
    assert ("Approved", "Reviewed") not in dims.ASSUMPTION_EDGES and min(state[-3:]) < max(state)


def test_registry_refuses_after_a_restart_and_replays_add_nothing(spark):
    schema = "company_id long, hash string, file_id long, uploaded_at timestamp"
    root, src = scratch(), scratch() + "/in"
    write = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b={n}")
    read = lambda: spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(src)

    def run(checkpoint):
        ST.intake(read(), root, checkpoint).start().awaitTermination(200)
        return {r.file_id for r in spark.read.parquet(f"{root}/registry").collect()}, {r.file_id for r in spark.read.parquet(f"{root}/refused").collect()}

    first = scratch() + "/c"
    write([(1, "aa1", 10, at(0)), (1, "aa1", 11, at(1)), (2, "aa1", 12, at(0)), (1, "bb2", 13, at(0))], 0)
    assert run(first) == ({10, 12, 13}, {11})
    write([(1, "aa1", 14, at(9)), (1, "cc3", 15, at(9))], 1)
    assert run(first) == ({10, 12, 13, 15}, {11, 14})
    # the whole input again under another checkpoint: everything is known by now
    assert run(scratch() + "/c") == ({10, 12, 13, 15}, {10, 11, 12, 13, 14, 15})
    assert spark.read.parquet(f"{root}/registry").count() == 4


def test_a_batch_taken_twice_replaces_itself(spark):
    schema = "company_id long, hash string, file_id long, uploaded_at timestamp"
    root, src = scratch(), scratch() + "/in"
    spark.createDataFrame([(1, "aa1", 10, at(0)), (1, "bb1", 11, at(0))], schema).write.parquet(src)
    import shutil

    for again in range(2):  # the offsets are lost, the registry is not: batch 0 of the same run comes again
        checkpoint = root + "/c"
        shutil.rmtree(checkpoint, ignore_errors=True)
        ST.intake(spark.readStream.schema(schema).parquet(src), root, checkpoint).start().awaitTermination(200)
        assert spark.read.parquet(f"{root}/registry").count() == 2 and spark.read.parquet(f"{root}/refused").count() == 0


def test_audit_counts_close_their_windows(spark):
    schema = "actor string, action string, at timestamp"
    batches = [[("u", "view", at(10)), ("u", "view", at(20)), ("v", "view", at(3700))], [("u", "edit", at(30)), ("w", "view", at(20_000))], [("w", "view", at(40_000))]]
    q = ST.audit_counts(feed(spark, batches, schema)).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", scratch()).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = {(r.actor, r.action, r.events) for r in spark.table("counts").collect()}
    assert {("u", "view", 2), ("v", "view", 1)} <= got


def test_facts_stream_replaces_its_batch(spark):
    from ledgerspan.operators import facts as FA
    from ledgerspan.sources import filings as FL

    sf, d = "/root/testdata/sf0.001", scratch()
    cells = FL.raw_cells(spark, sf).where("document_id < 3")
    cells.write.parquet(f"{d}/cells")
    docs = FL.documents(spark, sf)
    stream = spark.readStream.schema(cells.schema).parquet(f"{d}/cells")
    ST.facts(stream, docs, f"{d}/facts", f"{d}/c").start().awaitTermination(200)
    want = FA.build_facts(spark.read.parquet(f"{d}/cells"), docs).count()
    assert spark.read.parquet(f"{d}/facts").count() == want > 0
    ST.facts(stream, docs, f"{d}/facts", f"{d}/c2").start().awaitTermination(200)  # the same batch number again
    assert spark.read.parquet(f"{d}/facts").count() == want


def test_limiter_query_against_the_ordered_loop(spark):
    from ledgerspan.plans.q_stream import st03
    from ledgerspan.sources import derived as D

    sf = "/root/testdata/sf0.001"
    rows = [(r.actor, r.event_id, r.at) for r in D.audit_events(spark, sf).select("actor", "event_id", "at").collect()]
    got = {r.event_id: r.verdict for r in st03(spark, sf).collect()}
    assert got == limiter(rows, 5, 86_400) and set(got.values()) == {"accepted", "refused"}


def test_a_key_calls_the_state_store_per_chunk_and_not_per_event():
    from types import SimpleNamespace as Some

    calls, store = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def do(*args):
                calls.append((self.name, call))
                if call == "appendList":
                    store.setdefault(self.name, []).extend(args[0])
                elif call in ("put", "update"):
                    store[self.name] = args[0]
                elif call == "clear":
                    store.pop(self.name)
                return self.name in store if call == "exists" else iter(store[self.name]) if call == "get" and self.name == "waiting" else store.get(self.name)

            return do

    timers = []
    p = ST._in_order(lambda last, at, body: ((body,), (body, last[0] if last else None)), "state string", "string", ["key", "event_id", "state", "previous"], 0, 10**9)
    p.init(Some(getListState=lambda name, _: State(name), getValueState=lambda name, _: State(name), registerTimer=timers.append))
    n, clock = 5000, Some(getCurrentWatermarkInMs=lambda: 0)
    rows = [Some(at_us=i * 1000, event_id=i, body=str(i)) for i in range(1, n + 1)]
    random.Random(3).shuffle(rows)
    assert not list(p.handleInputRows(("k",), iter(rows), clock)) and timers == [1]
    first = list(p.handleExpiredTimer(("k",), Some(getCurrentWatermarkInMs=lambda: 1200), None))
    rest = list(p.handleExpiredTimer(("k",), Some(getCurrentWatermarkInMs=lambda: n), None))
    assert [r.event_id for r in first] == list(range(1, 1201)) and [r.event_id for r in rest] == list(range(1201, n + 1)) and rest[0].previous == "1200"
    assert 1201 in timers and len(timers) == 4 and len(calls) < 30 and "waiting" not in store
