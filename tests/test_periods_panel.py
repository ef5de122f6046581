"""The axis per company with its refusals, and the panel: one fault per clause, and what stops a clause."""

import pytest

from ledgerspan.operators import panel as PN
from ledgerspan.operators import periods as PD
from ledgerspan.operators import portfolio as PF
from ledgerspan.session import stage_root
from ledgerspan.sources import derived as D

SF = "/root/testdata/sf0.001"


def test_axis_problems(spark):
    rows = [(1, y) for y in (1999, 2000, 2001)] + [(2, y) for y in (1998, 1999)] + [(3, y) for y in (1997, 1999, 2001)] + [(4, 2001), (4, 2001)]
    wide = spark.createDataFrame(rows, "company_id long, year int")
    got = {r.company_id: r.period_problem for r in PD.company_axis(wide, (2002, 2003)).collect()}
    assert got[1] is None
    assert got[2] == "first forecast year 2002 does not follow the last actual 1999"
    assert got[3] == "historical years are not consecutive: 1997 -> 1999, 1999 -> 2001"
    assert got[4] == "historical years are repeated"
    of = lambda axis: PD.company_axis(wide.where("company_id = 1"), axis).first()
    assert of((2002, 2004)).period_problem == "forecast years are not consecutive: 2002 -> 2004"
    assert of((2003, 2002)).period_problem == "forecast years are not in ascending order"
    assert of(()).period_problem == "no forecast year"
    own = {r.company_id: r.forecast_years for r in PD.company_axis(wide, 2).collect()}
    assert own[1] == [2002, 2003] and own[2] == [2000, 2001]
    assert PD.company_axis(wide.limit(0), 5).count() == 0


def test_company_behind_the_axis_is_refused_and_one_with_its_own_axis_compounds_every_year(spark):
    from ledgerspan.plans.model import Model

    keep = "year <= 2001 - company_id % 3"
    ledger, scenarios, assumptions = D.ledger(spark, SF, keep), D.scenarios(spark, SF), D.assumptions(spark, SF, keep)
    fixed = {(r.company_id, r.scenario_id): r.blocked_by for r in Model(ledger, scenarios, assumptions, D.FORECAST_YEARS).status.collect()}
    assert fixed[2, "base"] == "periods: first forecast year 2002 does not follow the last actual 1999"
    assert fixed[3, "base"] is None
    own = Model(ledger, scenarios, assumptions, 5)
    years = {}
    for r in own.forecast.select("company_id", "year", "last_actual").distinct().collect():
        years.setdefault((r.company_id, r.last_actual), []).append(r.year)
    assert sorted(years[2, 1999]) == [2000, 2001, 2002, 2003, 2004]
    assert all(sorted(ys) == [last + i for i in range(1, 6)] for (_, last), ys in years.items())
    checks = own.checks.where("check_name = 'WACC above terminal growth'").groupBy("status").count().collect()
    assert checks and "SKIP" not in {r.status for r in checks}


GOOD = dict(hash="a", found_hash="a", scale_confirmed=True, currency_confirmed=True, facts=10, verified=10, unmapped=0, double_counts=0, bare=0, build_error=None)
EVIDENCE_FAULTS = {"17.1": dict(found_hash="b"), "17.2": dict(currency_confirmed=False), "17.4": dict(scale_confirmed=False), "17.5": dict(verified=9), "17.6": dict(unmapped=2), "17.7": dict(double_counts=1), "17.30": dict(bare=1)}
LEDGER_FAULTS = {2: {"17.8", "17.15"}, 3: {"17.9"}, 4: {"17.11"}, 5: {"17.13"}, 6: {"17.12"}, 7: {"17.10"}}
SCHEMA = "company_id long, hash string, found_hash string, scale_confirmed boolean, currency_confirmed boolean, facts long, verified long, unmapped long, double_counts long, bare long, build_error string"


@pytest.fixture(scope="module")
def staged(spark):
    from ledgerspan.plans.q_panel import tied_model

    return tied_model(spark, SF).staged(stage_root(spark))


def evidence(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
    return spark.createDataFrame([(k, *[{**GOOD, **v}[n] for n in names]) for k, v in rows.items()], SCHEMA)


def panel(spark, staged, rows):
    out = {}
    for r in PN.evaluate(staged, evidence(spark, rows)).collect():
        out[r.company_id, r.scenario_id, r.clause] = r
    return out


def test_one_ledger_fault_fails_its_clauses_and_no_others(spark, staged):
    ids = [r.company_id for r in staged.scenarios.select("company_id").distinct().collect()]
    got = panel(spark, staged, {i: {} for i in ids})
    assert len(got) == len(ids) * 4 * 30
    historical = [f"17.{n}" for n in (8, 9, 10, 11, 12, 13, 15)]
    for i in ids:
        fails = {c for c in historical if got[i, "base", c].status == "FAIL"}
        assert fails >= LEDGER_FAULTS.get(i % 11, set()) and (fails or i % 11 not in LEDGER_FAULTS)
        if i % 11 not in LEDGER_FAULTS:
            assert {got[i, "base", c].status for c in historical} == {"PASS"}, i
    ready = {(r.company_id, r.scenario_id): r.releasable for r in PF.readiness(PN.evaluate(staged, evidence(spark, {i: {} for i in ids}))).collect()}
    assert any(ready.values()) and not all(ready.values())
    assert not any(ready[i, "base"] for i in ids if i % 11 in LEDGER_FAULTS)


def test_evidence_faults_and_what_stops_a_clause(spark, staged):
    rows = {i: dict(f) for i, f in enumerate(EVIDENCE_FAULTS.values())}
    rows[8] = dict(build_error="3 facts not verified")
    got = panel(spark, staged, rows)
    for i, clause in enumerate(EVIDENCE_FAULTS):
        fails = {c for c in EVIDENCE_FAULTS if got[i, "base", c].status == "FAIL"}
        assert fails == ({"17.2", "17.4"} if clause in ("17.2", "17.4") else {clause})
    stopped = got[8, "base", "17.24"]
    assert (stopped.status, stopped.blocked_by, stopped.detail) == ("SKIP", "statements: 3 facts not verified", "the valuation did not build")
    assert got[8, "base", "17.5"].status == "PASS" and got[8, "base", "17.5"].blocked_by is None
    assert all(r.detail and (r.status != "SKIP" or r.clause in ("17.14", "17.21", "17.26", "17.28") or r.blocked_by) for r in got.values() if r.company_id in rows)
    blocked = got[0, "base", "17.16"]  # company 0 has no tax rate
    assert blocked.blocked_by.startswith("forecast: drivers") and got[0, "base", "17.18"].status == "FAIL" and got[0, "base", "17.22"].blocked_by == blocked.blocked_by
