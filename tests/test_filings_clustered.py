"""The filings stay clustered on the document from the ledger to the evidence: joins and groupings move no cell again."""

from __future__ import annotations

from decimal import Decimal as D

import pytest

from ledgerspan.operators import handoff as HO
from ledgerspan.operators import mapping as MP
from ledgerspan.operators import panel as PN
from ledgerspan.operators import review as RV
from ledgerspan.session import cut_lineage, joins_keep_clustering
from ledgerspan.sources import filings as FL

LEDGER = "company_id LONG, statement STRING, account STRING, year INT, value DECIMAL(25,8), origin STRING"


def _moved(df) -> list[str]:
    with joins_keep_clustering(df.sparkSession):
        return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def filing(unbroadcast, tmp_path):
    spark = unbroadcast
    spark.createDataFrame([(k, f"Company {k}", 0) for k in (6, 7, 13, 17, 32)], "s_suppkey LONG, s_name STRING, s_nationkey INT").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = [(k, s, a, y, D(100 * (k or 0) + y % 7), "reported") for k in (6, 7, 13, 17, 32, None) for s, a in (("income", "revenue"), ("income", "cogs"), ("balance", "cash"), ("balance", "other_current_assets")) for y in (1999, 2000)]
    ledger = cut_lineage(spark.createDataFrame(rows, LEDGER), "company_id")
    return FL.Filing(spark, str(tmp_path), ledger, "document_id % 2 = 1"), ledger


def test_a_stage_table_keeps_its_clustering_and_leaves_no_name(spark):
    rows = [(k, f"f{i}", i) for k in range(9) for i in range(3)] + [(None, "f0", 0)]
    a = cut_lineage(spark.createDataFrame(rows, "document_id LONG, fact_id STRING, n INT"), "document_id")
    assert sorted(map(str, a.collect())) == sorted(map(str, spark.createDataFrame(rows, a.schema).collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stage_")]
    assert not _moved(a.groupBy("document_id", "fact_id").count())
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "true"


def test_cells_decisions_and_evidence_move_nothing(filing):
    f, ledger = filing
    cells = FL.raw_cells(ledger.sparkSession, "", ledger)
    assert cells.where("document_id = 6").count() == 8 + 4 + 2 * 2 + 2 + 2 * 8  # values, labels, years, corners, memorandum
    assert not _moved(cells.distinct())
    assert not _moved(MP.statement_bookmarks(cells))
    assert not _moved(RV.apply_decisions(f.facts, f.decisions))
    printed, _ = MP.build_ledger(MP.normalise(f.mappings, f.reviewed))
    assert not _moved(printed)
    assert not _moved(MP.trace(f.mappings, f.reviewed, printed).where("NOT has_lineage"))


def test_decisions_and_batches_are_those_of_each_round(filing):
    f, _ = filing
    got = {(r.document_id, r.fact_id, r.event_id): (r.action, r.actor) for r in f.decisions.collect()}
    for r in f.facts.collect():
        marked = r.document_id is not None and (r.document_id + r.row + r.col) % 17 == 0
        assert got.pop((r.document_id, r.fact_id, 1)) == ("correct" if r.parsed.value is None else "reject" if marked else "accept", "reviewer-a")
        if marked and r.col == 4:
            assert got.pop((r.document_id, r.fact_id, 2)) == ("accept", "reviewer-b")
        if marked and r.parsed.value is not None and r.document_id % 2 == 1:
            assert got.pop((r.document_id, r.fact_id, 3)) == ("accept", "reviewer-c")
    assert not got
    last = {}
    for r in f.mappings.collect():
        last.setdefault((r.document_id, r.version), set()).add(r.account)
    assert last[6, 2] == {"cogs", "gross_profit"} and last[17, 2] == last[32, 2] == {"inventory", "other_current_assets"}  # moved and split by hand
    assert last[6, 1] == {"revenue", "cash", "other_current_assets"} and (13, 2) not in last


def test_lineage_is_known_without_lists_and_refusals_read_the_staged_ledger(filing, tmp_path):
    f, _ = filing
    printed, _ = MP.build_ledger(MP.normalise(f.mappings, f.reviewed))
    extra = printed.limit(1).selectExpr("company_id", "statement", "'goodwill' AS account", "year", "value", "origin", "page")
    traced = MP.trace(f.mappings, f.reviewed, printed.unionByName(extra))
    assert [r.account for r in traced.where("NOT has_lineage").collect()] == ["goodwill"]
    assert "collect_list" not in traced.where("NOT has_lineage").select("company_id")._jdf.queryExecution().executedPlan().toString()
    assert traced.where("has_lineage").first().facts[0].raw_label
    ev = PN.filing_evidence(f.reviewed, f.mappings, f.documents.withColumn("found_hash", f.documents["hash"]), printed)
    assert {(r.company_id, r.facts, r.bare) for r in ev.collect()} == {(k, 8, 0) for k in (6, 7, 13, 17, 32)}
    ledger, _, refused = HO.publish(ev, printed, printed.selectExpr("company_id", "'balance_sheet' AS section", "page"), str(tmp_path / "out"))
    assert {r.company_id for r in ledger.collect()} | {r.company_id for r in refused.collect()} == {6, 7, 13, 17, 32}


def test_the_panel_reads_the_transactions_once_and_its_ledger_stays_by_company(spark, tmp_path):
    from datetime import datetime

    from ledgerspan.plans.q_panel import tied_model
    from ledgerspan.session import stage_root
    from ledgerspan.sources import derived as DV

    line = "l_suppkey LONG, l_partkey LONG, l_shipdate TIMESTAMP, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_quantity DOUBLE, l_returnflag STRING, l_linestatus STRING"
    rows = [(k, p, datetime(y, 3, 4), 100.0 * k + p, 0.05, 0.02, 2.0, "RA"[p % 2], "FO"[p % 2]) for k in (1, 2) for p in (1, 2, 3) for y in (2000, 2001)]
    spark.createDataFrame([*rows, *rows[:2]], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, 10.0 * p) for p in (1, 2, 3)], "p_partkey LONG, p_retailprice DOUBLE").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "s_suppkey LONG").write.parquet(f"{tmp_path}/supplier.parquet")
    m, sf = tied_model(spark, str(tmp_path)), str(tmp_path)
    for df in (m.ledger, m.assumptions):
        assert "l_suppkey" not in df._jdf.queryExecution().executedPlan().toString()
    told = lambda df: sorted(map(str, df.collect()))
    assert told(m.ledger) == told(DV.tied_ledger(spark, sf)) and m.ledger.count() > 100
    assert told(m.assumptions.select("company_id", "scenario_id", "code", "value", "seq")) == told(DV.assumptions(spark, sf, rows=DV.TIED_ASSUMPTIONS).select("company_id", "scenario_id", "code", "value", "seq"))
    s = m.staged(stage_root(spark))
    assert told(s.ledger) == told(m.ledger)
    assert not _moved(s.ledger.groupBy("company_id", "year").count()) and not _moved(FL.raw_cells(spark, sf, s.ledger).distinct())


def test_accounts_that_read_alike_give_one_label(spark):
    ledger = cut_lineage(spark.createDataFrame([(1, "income", a, y, D(5), "reported") for a in ("revenue", "unheard_of", "unknown") for y in (2000, 2001)], LEDGER), "company_id")
    labels = FL.raw_cells(spark, "", ledger).where("col = 0 AND (row < 90 OR row IS NULL) AND (text <> '' OR text IS NULL)").collect()
    assert sorted((r.text is None, r.text) for r in labels if r.text) == [(False, "Net sales")] and len([r for r in labels if r.text is None]) == 1
