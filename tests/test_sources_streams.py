import json
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerspan.operators import audit as AU
from ledgerspan.operators import metrics as X
from ledgerspan.sources import readers as R
from ledgerspan.sources import writers as W
from ledgerspan.streaming import streams as ST


def scratch():
    return tempfile.mkdtemp(prefix="spark-")


def test_read_reported_quarantines(spark):
    d = scratch()
    rec = {"company_id": "a", "statement": "income", "account": "revenue", "document": "10-K", "page": 4, "line_item": "Net sales", "values": {"2024A": "10.5", "2025A": None, "2026A": "NaN"}}
    with open(f"{d}/x.json", "w") as f:
        f.write(json.dumps(rec) + "\n" + json.dumps(rec | {"account": "no_such_line"}) + "\n")
    good, bad = R.read_reported(spark, d)
    assert [(r.year, str(r.value)) for r in good.collect()] == [(2024, "10.50000000")]
    assert sorted(r.problem for r in bad.collect()) == ["not a decimal", "unknown account", "unknown account"]


def test_period_rules_and_required_fields(spark):
    p = spark.createDataFrame([("a", 0, "2024A", 2024, "A"), ("a", 1, "2026E", 2026, "E"), ("b", 0, "2025A", 2025, "A"), ("b", 1, "2026E", 2026, "E")], "company_id string, ordinal int, label string, year int, kind string")
    assert [(r.company_id, r.problem) for r in R.period_violations(p).collect()] == [("a", "gap or disorder")]
    c = spark.createDataFrame([("a", " ", None), ("b", "x", "y")], "company_id string, name string, currency string")
    assert sorted((r.company_id, r.field) for r in R.required_fields(c, ["name", "currency"]).collect()) == [("a", "currency"), ("a", "name")]


def test_file_intake_and_hashes(spark):
    d = scratch()
    for name, body in (("ok.pdf", b"%PDF-1.7\nbody\n%%EOF\n"), ("cut.pdf", b"%PDF-1.4\nbody"), ("no.txt", b"hello"), ("big.pdf", b"%PDF-1.4" + b"x" * 4000)):
        with open(f"{d}/{name}", "wb") as f:
            f.write(body)
    got = {r.path.rsplit("/", 1)[1]: r for r in R.file_intake(spark, d, max_bytes=2000).collect()}
    assert got["ok.pdf"].refusal is None and got["ok.pdf"].version == "1.7"
    assert (got["cut.pdf"].refusal, got["no.txt"].refusal, got["big.pdf"].refusal) == ("ING-010-02", "ING-010-01", "ING-020-08")
    man = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    found = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert {r.path: r.state for r in R.verify_hashes(found, man).collect()} == {"a": "match", "b": "mismatch", "c": "missing", "d": "extra"}


def test_csv_defence_and_double_losses(spark):
    df = spark.createDataFrame([("=1+1", "ok"), ("x", "@b")], "a string, b string").withColumn("v", F.lit("-5").cast("decimal(25,8)"))
    rows = W.neutralised(df).collect()
    assert [(r.a, r.b) for r in rows] == [("'=1+1", "ok"), ("x", "'@b")]
    n = spark.createDataFrame([("0.1",), ("12345678901234567.12345678",)], "v string").withColumn("v", F.col("v").cast("decimal(25,8)"))
    assert W.double_losses(n, "v").count() == 1


def test_metrics(spark):
    df = spark.createDataFrame([(1, 2025, "10", "4"), (2, 2025, None, "4"), (3, 2025, "0", "4")], "company_id int, year int, revenue string, cogs string")
    df = df.withColumns({c: F.col(c).cast("decimal(25,8)") for c in ("revenue", "cogs")})
    ms = [("margin_pct", "try_divide(margin, revenue) * 100", ("margin", "revenue"), "percent"), ("margin", "revenue - cogs", ("revenue", "cogs"), "currency")]
    got = {(r.company_id, r.metric): r for r in X.evaluate(df, ms).collect()}
    assert got[(1, "margin_pct")].value == 60 and got[(2, "margin")].reason == "missing: revenue" and got[(3, "margin_pct")].reason == "undefined"
    assert X.required_inputs(ms) == ["cogs", "revenue"] and X.dependents(ms, ["cogs"]) == ["margin", "margin_pct"]
    with pytest.raises(ValueError):
        X.order([("a", "b", ("b",), "x"), ("b", "a", ("a",), "x")])


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_stream_rate_limit(spark):
    ST.use_state_store(spark)
    d = scratch()
    rows = [("k", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 3, 11, 12))] + [("end", 9, "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "key string, event_id bigint, at string").withColumn("at", F.to_timestamp("at")).write.parquet(d + "/in")
    events = spark.readStream.schema("key string, event_id bigint, at timestamp").parquet(d + "/in")
    got = {r.event_id: r.verdict for r in _drain(ST.rate_limit(events, 2, 10), "limited")}
    yes, no = "accepted", "refused"
    assert got == {0: yes, 1: yes, 2: no, 3: no, 4: yes, 5: yes}


def test_stream_transitions_and_dedupe(spark):
    ST.use_state_store(spark)
    d = scratch()
    rows = [("e", 1, "Draft"), ("e", 2, "Reviewed"), ("e", 3, "Needs Source"), ("e", 4, "Draft"), ("end", 400_000, "Draft")]
    spark.createDataFrame(rows, "entity_id string, event_id bigint, state string").withColumn("at", F.timestamp_seconds(F.col("event_id") + 1_000_000)).write.parquet(d + "/t")
    s = spark.readStream.schema("entity_id string, event_id bigint, state string, at timestamp").parquet(d + "/t")
    assert [(r.event_id, r.previous, r.state) for r in _drain(ST.illegal_transitions(s), "illegal")] == [(3, "Reviewed", "Needs Source")]
    spark.createDataFrame([("a", "h1"), ("a", "h1"), ("b", "h1")], "company_id string, hash string").withColumn("uploaded_at", F.to_timestamp(F.lit("2024-01-01"))).write.parquet(d + "/u")
    u = spark.readStream.schema("company_id string, hash string, uploaded_at timestamp").parquet(d + "/u")
    assert len(_drain(ST.dedupe(u), "deduped")) == 2


def test_rate_burst_matches_brute_force(spark):
    rows = [("k", i, t) for i, t in enumerate((0, 5, 9, 10, 14, 30, 39, 40))]
    e = spark.createDataFrame(rows, "actor string, event_id bigint, s int").withColumn("at", F.timestamp_seconds("s"))
    got = {r.event_id: r.in_window for r in AU.rate_burst(e, "actor", 10, 2).collect()}
    assert got == {i: sum(1 for _, _, u in rows if t - 10 < u <= t) for _, i, t in rows}


def test_export_set_from_a_staged_model(spark, tmp_path):
    from ledgerspan.operators import exports as EX
    from ledgerspan.plans.q_model import model
    from ledgerspan.sources import writers as W

    lazy = model(spark, "/root/testdata/sf0.001")
    staged = lazy.staged(f"{tmp_path}/stage")
    tables = EX.export_set(staged)
    assert set(tables) == {"cover", "schedules", "assumptions", "dcf", "checks", "limitations"} | {f"{a}_{b}" for a in ("historical", "forecast") for b in ("is", "bs", "cf")}
    assert "lineitem" not in tables["checks"]._jdf.queryExecution().optimizedPlan().toString()
    W.export_tables({k: tables[k] for k in ("cover", "historical_bs")}, f"{tmp_path}/out", {"version": "1"}, unavailable={"sensitivity": "not asked for"})
    back = spark.read.parquet(f"{tmp_path}/out/historical_bs")
    assert back.count() == EX.export_set(lazy)["historical_bs"].count()
    assert {(r.table_name, r.state) for r in spark.read.parquet(f"{tmp_path}/out/_tables").collect()} == {("cover", "available"), ("historical_bs", "available"), ("sensitivity", "unavailable")}
