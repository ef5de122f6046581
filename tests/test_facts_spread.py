"""The shared steps of the filings work on all shuffle partitions; a cell is judged once per fact."""

from __future__ import annotations

from decimal import Decimal as D

from ledgerspan.operators import facts as FA
from ledgerspan.operators import mapping as MP
from ledgerspan.operators import review as RV


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_decisions_and_batches_are_spread(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = spark.createDataFrame([(1, 1, "1-1", 0, 0, "", "c")], "document_id INT, page INT, table_id STRING, row INT, col INT, text STRING, caption STRING")
    d = spark.createDataFrame([(1, "f", 1, "accept", "a", "r", None, 1), (1, "f", 2, "reject", "b", "s", None, 2)],
                              "document_id INT, fact_id STRING, event_id LONG, action STRING, actor STRING, reason STRING, corrected_value DECIMAL(25,8), at INT")
    m = spark.createDataFrame([(1, "f", "cash", 1), (1, "f", "debt", 2)], "document_id INT, fact_id STRING, account STRING, version INT")
    latest, batch = RV.latest_decision(d), MP.latest_batch(m)
    assert [r.action for r in latest.collect()] == ["reject"] and [r.account for r in batch.collect()] == ["debt"]
    for df in (FA.clustered(cells), latest, batch):
        assert "REPARTITION_BY_NUM" in _plan(df) and f", {n})" in _plan(df)


def test_cells_without_a_fact_and_with_an_unverified_one_are_broken(spark):
    facts = spark.createDataFrame(
        [(1, f, p, "l", "1", y, D(1), "balance", "accept", "a", "r", v) for f, p, y, v in (("f1", 1, "2001", True), ("f2", 2, "2001", False), ("f3", 3, "2000", True), ("f4", None, "1999", True), ("f5", 4, "2000 (restated)", True))],
        "document_id INT, fact_id STRING, page INT, raw_label STRING, raw_value STRING, period_label STRING, value DECIMAL(25,8), statement STRING, action STRING, actor STRING, reason STRING, verified BOOLEAN")
    maps = spark.createDataFrame([(1, f, "cash", "one_to_one", "as_printed", None) for f in ("f1", "f2", "f3", "f4", "f5")], "document_id INT, fact_id STRING, account STRING, mapping_type STRING, sign STRING, allocation DECIMAL(25,8)")
    ledger = spark.createDataFrame([(1, "balance", "cash", y, D(1)) for y in (2001, 2000, 2000, 1999, 1998)], "company_id INT, statement STRING, account STRING, year INT, value DECIMAL(25,8)")
    c = MP.cell_checks(maps, facts, ledger, facts)
    assert _plan(c).count("Scan ExistingRDD") == 4  # mappings, ledger, facts, gates: what review said is not joined again
    got = {r.check_name: (r.cells, r.broken, r.status) for r in c.collect()}
    assert got == {"every cell cites a page": (4, 2, "FAIL"), "every cell is verified": (4, 2, "FAIL")}
