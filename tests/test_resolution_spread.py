"""Resolution keeps its partitions and orders a code's rows once; limitations read the status once."""

from __future__ import annotations

from types import SimpleNamespace

from ledgerspan.operators import exports as EX
from ledgerspan.operators import scenarios as S
from ledgerspan.plans import q_panel
from ledgerspan.session import stage_root


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = "company_id INT, scenario_id STRING, code STRING, period INT, unit STRING, value DECIMAL(25,8), status STRING, source_type STRING, seq INT"


def test_resolution_picks_as_stated_and_is_not_merged(spark):
    scenarios = spark.createDataFrame([(1, "base", None), (1, "up", "base"), (2, "a", "b"), (2, "b", "a")], "company_id INT, scenario_id STRING, parent_id STRING")
    one = lambda c, s, p, v, n: (c, s, "beta", p, "ratio", v, "Approved", "Company Filing", n)
    from decimal import Decimal as D
    a = spark.createDataFrame([one(1, "base", None, D(1), 1), one(1, "base", 2002, D(2), 2), one(1, "up", None, D(3), 3), one(1, "up", 2009, D(4), 0), one(2, "a", None, D(5), 1), one(2, "b", None, D(6), 1)], ROWS)
    r = S.resolve_all(scenarios, a, (2002, 2003))
    got = {(x.company_id, x.scenario_id, x.year): (int(x.value), x.depth, x.period) for x in r.collect()}
    assert got[1, "base", 0] == (1, 0, None) and got[1, "base", 2002] == (2, 0, 2002) and got[1, "base", 2003] == (1, 0, None)
    assert got[1, "up", 0] == (4, 0, 2009) and got[1, "up", 2002] == (2, 1, 2002) and got[1, "up", 2003] == (3, 0, None)
    assert got[2, "a", 0] == (5, 0, None) and got[2, "b", 2003] == (6, 0, None) and len(got) == 12
    axis = spark.createDataFrame([(1, [2003])], "company_id INT, forecast_years ARRAY<INT>")
    own = {(x.company_id, x.scenario_id, x.year) for x in S.resolve_all(scenarios, a, axis).collect()}
    assert own == {(1, "base", 0), (1, "base", 2003), (1, "up", 0), (1, "up", 2003), (2, "a", 0), (2, "b", 0)}
    assert "REPARTITION_BY_NUM" in _plan(r) and "SortAggregate" not in _plan(r)


def test_limitations_read_the_status_once(spark):
    status = spark.createDataFrame([(1, "base", "drivers: beta: missing", False, ["beta"]), (2, "base", None, True, []), (3, "base", "no actual period", False, None)],
                                   "company_id INT, scenario_id STRING, blocked_by STRING, may_calculate BOOLEAN, missing_inputs ARRAY<STRING>")
    df = EX.limitations(SimpleNamespace(status=status))
    assert sorted(map(tuple, df.collect())) == [(1, "base", "forecast", "drivers"), (1, "base", "valuation", "missing: beta"), (3, "base", "forecast", "no actual period")]
    assert "Union" not in _plan(df)


def test_staged_resolution_is_spread_again(spark):
    sf = "/root/testdata/sf0.001"
    m = q_panel.tied_model(spark, sf).staged(stage_root(spark))
    assert "REPARTITION_BY_NUM" in _plan(m.resolved_all)
    assert m.resolved_all.count() == q_panel.tied_model(spark, sf).resolved_all.count()
