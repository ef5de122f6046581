"""Versioned records, hand-off and partial recomputation: refusals, atomicity, and files that must not move."""

import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerspan.operators import handoff as HO
from ledgerspan.operators import metrics as X
from ledgerspan.sources import readers as R
from ledgerspan.sources.versioned import Versioned, stored


def scratch():
    return tempfile.mkdtemp(prefix="spark-")


def rows(spark, data, seen=0):
    df = spark.createDataFrame(data, "k long, code string, amount string").withColumn("amount", F.col("amount").cast("decimal(25,8)"))
    return df.withColumn("seen_version", F.lit(seen))


def test_versions_compare_and_set(spark):
    first = rows(spark, [(1, "a", "0.10000001"), (1, "b", None), (2, "a", "5")])
    v = Versioned(spark, scratch(), first.drop("seen_version").schema, ["k"])
    assert v.latest().count() == 0 and v.write(first).count() == 0
    assert v.write(rows(spark, [(1, "a", "7")], 1)).count() == 0
    stale = v.write(rows(spark, [(1, "a", "9"), (2, "a", "6"), (3, "a", "1")], 1)).collect()
    assert {(r.k, r.seen, r.found) for r in stale} == {(1, 1, 2), (3, 1, 0)}
    got = {(r.k, r.code): (str(r.amount), r.version) for r in v.latest().collect()}
    assert got == {(1, "a"): ("7.00000000", 2), (2, "a"): ("6.00000000", 2)}  # replaced whole: (1, b) is gone, 3 was never written
    assert {(r.code, r.amount) for r in v.history().where("k = 1 AND version = 1").collect()} == {("a", "0.10000001"), ("b", None)}
    assert [(r.code, str(r.amount)) for r in v.one(2).collect()] == [("a", "6.00000000")] and v.one(99).count() == 0
    mixed = rows(spark, [(2, "a", "1")], 2).unionByName(rows(spark, [(2, "b", "1")], 1))
    assert [r.k for r in v.write(mixed).collect()] == [2]


def test_a_lost_race_compares_again_and_a_dead_writer_leaves_nothing(spark, monkeypatch):
    root = scratch()
    first = rows(spark, [(1, "a", "1")])
    a, b = (Versioned(spark, root, first.drop("seen_version").schema, ["k"]) for _ in range(2))
    mark, raced = a._mark, []

    def late(number, folder):
        if not raced:
            raced.append(b.write(rows(spark, [(1, "a", "2")])).count())
        return mark(number, folder)

    monkeypatch.setattr(a, "_mark", late)
    refused = a.write(first).collect()
    assert raced == [0] and [(r.k, r.seen, r.found) for r in refused] == [(1, 0, 1)]
    assert [str(r.amount) for r in a.latest().collect()] == ["2.00000000"]
    rows(spark, [(5, "x", "1")]).drop("seen_version").write.parquet(f"{root}/data/unmarked")  # files without a marker do not count
    open(f"{root}/commits/{len(a.commits()) + 1:012d}", "w").close()  # a writer that died on its marker
    assert b.latest().count() == 1 and b.write(rows(spark, [(1, "a", "3")], 1)).count() == 0
    assert [str(r.amount) for r in b.latest().collect()] == ["3.00000000"]


def test_floats_are_refused_at_any_depth(spark):
    for sql in ("1.5D AS x", "array(named_struct('v', 1.5F)) AS x", "map('a', array(1D)) AS x"):
        with pytest.raises(TypeError, match="float"):
            stored(spark.range(1).selectExpr("id", sql))
    kept = stored(spark.range(1).selectExpr("id", "array(named_struct('v', CAST(1.10 AS DECIMAL(25,8)))) AS x"))
    assert kept.first().x[0].v == "1.10000000"


METRICS = [("margin", "revenue - cogs", ("revenue", "cogs"), "currency"), ("share", "try_divide(cash, revenue)", ("cash", "revenue"), "ratio"), ("spread", "margin - cash", ("margin", "cash"), "currency")]


def test_only_affected_partitions_are_rewritten(spark):
    path = scratch() + "/metrics"
    wide = spark.createDataFrame([(1, 2001, "10", "4", "2"), (2, 2001, "20", None, "3")], "company_id long, year int, revenue string, cogs string, cash string")
    wide = wide.withColumns({c: F.col(c).cast("decimal(25,8)") for c in ("revenue", "cogs", "cash")})
    X.overwrite_affected(wide, METRICS, None, path)
    files = lambda m: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/metric={m}/*.parquet")}
    before = {m[0]: files(m[0]) for m in METRICS}
    out = X.overwrite_affected(wide.withColumn("cogs", F.lit("5").cast("decimal(25,8)")), METRICS, ["cogs"], path)
    assert files("share") == before["share"] and files("margin") != before["margin"] and files("spread") != before["spread"]
    assert {(r.company_id, r.metric): r.value for r in out.collect()}[2, "margin"] == 15


def test_handoff_is_whole_or_nothing_and_replaces_a_company(spark):
    root = scratch()
    ev = spark.createDataFrame([(1, None, True, True), (2, "3 facts not verified", True, True), (3, None, False, True), (4, None, True, True)], "company_id long, build_error string, scale_confirmed boolean, currency_confirmed boolean")
    led = spark.createDataFrame([(k, "income", "revenue", y, str(k * y)) for k in (1, 2, 3) for y in (2000, 2001)], "company_id long, statement string, account string, year int, value string")
    pages = spark.createDataFrame([(1, "income_statement", 4)], "company_id long, section string, page int")
    ledger, profile, refused = HO.publish(ev, led, pages, root)
    assert {r.company_id for r in ledger.collect()} == {1} == {r.company_id for r in profile.collect()}
    assert {(r.company_id, r.reason) for r in refused.collect()} == {(2, "3 facts not verified"), (3, "displayed_scale is not confirmed"), (4, "no figure to hand over")}
    p = profile.first()
    assert (p.last_actual, p.first_forecast, len(p.gaps)) == (2001, 2002, 11)
    again = led.where("company_id = 2").withColumn("value", F.lit("1"))
    fine = ev.where("company_id = 2").withColumn("build_error", F.lit(None).cast("string"))
    ledger, _, _ = HO.publish(fine, again, pages, root)
    assert {(r.company_id, r.value) for r in ledger.collect()} == {(1, "2000"), (1, "2001"), (2, "1")}


def test_driver_files_refuse_what_they_cannot_hold(spark):
    d = scratch()
    driver = lambda **k: {"name": "dso", "value": "45", "basis": "model_assumption", "source": "memo", **k}
    conflict = {"topic": "capex", "source_a": "A", "date_a": "d", "value_a": "1", "source_b": "B", "date_b": "e", "value_b": "2", "chosen": "A", "rationale": "newer"}
    files = [
        {"company_id": "ok", "drivers": [driver(), driver(year="2002E", value="1e2")], "conflicts": [conflict], "tax": {"basis": "statutory", "source": "p 9", "rates": {"2002E": "0.25"}}, "segments": {"north": "3"}},
        {"company_id": "bad", "drivers": [driver(value="0.123456789"), driver(name="dpo", value="NaN"), driver(name="beta", source=" "), driver(name="x", year="1990E"), driver(name="y", basis="guess"), driver(name="z", value="9" * 30)],
         "conflicts": [{**conflict, "chosen": "C"}, {**conflict, "rationale": " "}], "tax": {"basis": "", "source": "s", "rates": {}}, "segments": {"n": None}},
        {"company_id": "none"},
    ]
    with open(f"{d}/x.json", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in files)
    out = R.read_drivers(spark, d, ["2002E"])
    assert {(r.name, r.year, str(r.value)) for r in out["drivers"].collect()} == {("dso", None, "45.00000000"), ("dso", "2002E", "100.00000000")}
    assert out["conflicts"].count() == 1 and [str(r.rate) for r in out["tax"].collect()] == ["0.25000000"] and [r.segment for r in out["segments"].collect()] == ["north"]
    refused = {(r.company_id, r.block, r.item): r.reason for r in out["refused"].collect()}
    assert refused["bad", "drivers", "dso"] == "value: more decimals than are kept" and refused["bad", "drivers", "dpo"] == "value: not a decimal"
    assert refused["bad", "drivers", "beta"] == "not given: source" and refused["bad", "drivers", "x 1990E"] == "not a modelled year" and refused["bad", "drivers", "y"] == "unknown basis"
    assert refused["bad", "drivers", "z"] == "value: out of range" and refused["bad", "tax", "2002E"] == "not given: basis" and refused["none", "tax", "2002E"] == "no tax block"
    assert refused["bad", "segments", "n"] == "value: absent"


def test_a_hand_off_builds_its_filings_once(spark, monkeypatch):
    from ledgerspan.plans import q_store as QS

    built, real = [], QS.FL.Filing.__init__
    monkeypatch.setattr(QS.FL.Filing, "__init__", lambda self, *a, **k: (built.append(1), real(self, *a, **k))[1])
    monkeypatch.setattr(QS.HO, "publish", lambda evidence, ledger, pages, root: (ledger, pages, evidence))
    _, _, evidence = QS.handoff(spark, "/root/testdata/sf0.001")
    assert len(built) == 1 and evidence.columns[0] == "company_id"
