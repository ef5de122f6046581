"""Impact previews against a comparison of every figure, and versions that move with what they stand for."""

from pyspark.sql import functions as F

from ledgerspan.operators import audit as AU
from ledgerspan.operators import impact as IM
from ledgerspan.plans.q_model import model

SF = "/root/testdata/sf0.001"
CODES = ("revenue_growth", "dso", "debt_repayment", "beta", "terminal_growth", "interest_rate_on_debt", "dividend_payout_ratio", "capex_pct_revenue", "opex_pct_revenue", "diluted_shares")


def changes(m):
    """Another code for each company, a little larger than it is."""
    rows = m.assumptions.where("scenario_id = 'base'").withColumn("want", F.element_at(F.array(*map(F.lit, CODES)), ((F.col("company_id") + 1) % len(CODES) + 1).cast("int"))).where("code = want")
    return rows.groupBy("company_id", "scenario_id", "code").agg((F.max("value") * F.lit("1.01").cast("decimal(4,2)")).cast("decimal(25,8)").alias("value"))


def test_nothing_outside_the_closure_moves_and_the_preview_holds_what_does(spark):
    m = model(spark, SF)
    c = changes(m).cache()
    code_of = {r.company_id: r.code for r in c.collect()}
    figures = {}
    for r in IM.scenario_model(IM.doubled(m, c)).collect():
        sid, _, after = r.scenario_id.partition(IM.AFTER)
        figures.setdefault((r.company_id, sid, r.year, r.target), {})["after" if IM.AFTER in r.scenario_id else "before"] = r.value
    moved = {k for k, v in figures.items() if v.get("before") != v.get("after")}
    for company, sid, _, target in moved:
        assert target in IM.reaches(code_of[company]), (company, sid, target)
    got = IM.preview(m, c).collect()
    assert {(r.company_id, r.scenario_id, r.year, r.target) for r in got if r.state == "moved"} == {k for k in moved if figures[k].get("after") is not None}
    assert all(r.reason for r in got if r.state == "unavailable")
    assert {code_of[k[0]] for k in moved} >= {"revenue_growth", "beta", "opex_pct_revenue"}


def test_closure():
    assert {"cost_of_equity", "wacc", "enterprise_value", "per_share"} <= IM.reaches("beta") and "revenue" not in IM.reaches("beta")
    assert IM.reaches("no_such_driver") == frozenset() and IM.reaches("diluted_shares") == {"per_share"}
    assert "wacc" in IM.reaches("tax_rate") and "retained_earnings" in IM.reaches("dso") or "cash" in IM.reaches("dso")


def test_change_in_a_branch_leaves_the_others_out(spark):
    m = model(spark, SF)
    c = m.assumptions.where("scenario_id = 'upside' AND code = 'capex_pct_revenue' AND company_id < 4").selectExpr("company_id", "scenario_id", "code", "CAST(0.5 AS DECIMAL(25,8)) AS value")
    seen = {r.scenario_id for r in IM.preview(m, c).select("scenario_id").distinct().collect()}
    assert seen == {"upside", "stretch"}
    assert IM.preview(m, c.limit(0)).count() == 0


def test_digest_tree_depends_on_the_rows_alone(spark):
    rows = [(k, f"part {i}") for k in (1, 2) for i in range(3000)] + [(3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "k int, p string")
    of = lambda d: {r.k: r.fingerprint for r in AU.digest_tree(d, ["k"], F.col("p")).collect()}
    one = of(df.coalesce(1))
    assert one == of(df.repartition(7)) == of(df.orderBy(F.rand(3))) and one[1] == one[2]
    assert of(df.where("NOT (k = 1 AND p = 'part 7')"))[1] != one[1]
    assert of(df.dropDuplicates())[3] != one[3]  # a repeated row counts
    assert of(df.limit(0)) == {}


def test_version_moves_with_one_mapping_one_assumption_or_the_document(spark):
    docs = spark.createDataFrame([(1, "h1"), (2, "h2")], "document_id long, hash string")
    maps = spark.createDataFrame([(d, f"f{i}", "cash", "one_to_one", None, "as_printed", True) for d in (1, 2) for i in range(50)], "document_id long, fact_id string, account string, mapping_type string, allocation decimal(25,8), sign string, approved boolean")
    scen = spark.createDataFrame([(d, s) for d in (1, 2) for s in ("base", "down")], "company_id long, scenario_id string")
    res = spark.createDataFrame([(d, s, "beta", 0, "1.5", "Approved") for d in (1, 2) for s in ("base", "down")], "company_id long, scenario_id string, code string, year int, value string, status string")
    of = lambda d=docs, m=maps, r=res: {(x.company_id, x.scenario_id): x.version for x in AU.model_version(d, m, r, scen).collect()}
    v = of()
    assert len(set(v.values())) == 4 and v == of(m=maps.repartition(5))
    moved = of(m=maps.withColumn("account", F.when((F.col("document_id") == 1) & (F.col("fact_id") == "f7"), "debt").otherwise(F.col("account"))))
    assert {k for k in v if v[k] != moved[k]} == {(1, "base"), (1, "down")}
    moved = of(r=res.withColumn("value", F.when(F.expr("company_id = 2 AND scenario_id = 'down'"), "1.6").otherwise(F.col("value"))))
    assert {k for k in v if v[k] != moved[k]} == {(2, "down")}
    assert {k for k, x in of(d=docs.withColumn("hash", F.when(F.col("document_id") == 2, "other").otherwise(F.col("hash")))).items() if v[k] != x} == {(2, "base"), (2, "down")}
