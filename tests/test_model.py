"""Golden forecast and valuation, precedence, refusals, and checks that can fail."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspan.operators import forecast as FC
from ledgerspan.operators import ledger as L
from ledgerspan.operators import scenarios as S
from ledgerspan.operators import schedules as H
from ledgerspan.operators import valuation as V
from ledgerspan.plans.model import Model

IS = {"revenue": (920, 1000), "cogs": (534, 580), "operating_expenses": (232, 250), "interest_expense": (31, 30), "taxes": ("29.8", "33.6")}
BS = {
    "cash": (150, 200), "accounts_receivable": (140, 150), "inventory": (85, 90), "other_current_assets": (18, 20), "ppe_net": (470, 500), "other_noncurrent_assets": (60, 60),
    "accounts_payable": (75, 80), "other_current_liabilities": (38, 40), "debt": (320, 300), "other_noncurrent_liabilities": (50, 50), "common_equity": (295, 300), "retained_earnings": (145, 250),
}
CF = {
    "net_income": "106.4", "depreciation_amortization": 75, "stock_based_compensation": 10, "change_in_nwc": -10, "cash_flow_from_operations": "181.4", "capex": -105, "cash_flow_from_investing": -105,
    "debt_repayment": -20, "share_repurchases": -5, "dividends": "-1.4", "cash_flow_from_financing": "-26.4",
}
GROWTH, COGS = ["0.08", "0.07", "0.06", "0.05", "0.04"], ["0.578", "0.576", "0.574", "0.572", "0.570"]
DRIVERS = {
    "opex_pct_revenue": "0.250", "dso": "54.75", "inventory_days": "56.6379", "dpo": "50.3448", "other_current_assets_pct_revenue": "0.020", "other_current_liabilities_pct_revenue": "0.040",
    "depreciation_pct_beginning_ppe": "0.150", "capex_pct_revenue": "0.105", "interest_rate_on_debt": "0.060", "debt_repayment": "20.0", "sbc_pct_revenue": "0.010", "share_repurchases": "5.0",
    "dividend_payout_ratio": "0.100", "tax_rate": "0.24", "risk_free_rate": "0.042", "beta": "1.10", "equity_risk_premium": "0.055", "pretax_cost_of_debt": "0.055",
    "market_value_equity": "4000", "market_value_debt": "300", "terminal_growth": "0.025", "diluted_shares": "100",
}
UNITS = {"dso": "days", "inventory_days": "days", "dpo": "days", "debt_repayment": "currency", "share_repurchases": "currency", "market_value_equity": "currency", "market_value_debt": "currency", "diluted_shares": "shares"}
YEARS = (2026, 2027, 2028, 2029, 2030)
LEDGER = "company_id bigint, statement string, account string, year int, value string"
ASSUMPTION = "company_id bigint, scenario_id string, code string, period int, unit string, value string, status string, source_type string, seq int"


def ledger_rows(company=1):
    rows = [(company, "income", a, y, str(v)) for a, vs in IS.items() for y, v in zip((2024, 2025), vs)]
    rows += [(company, "balance", a, y, str(v)) for a, vs in BS.items() for y, v in zip((2024, 2025), vs)]
    return rows + [(company, "cashflow", a, 2025, str(v)) for a, v in CF.items()]


def assumption_rows(company=1, scenario="base"):
    rows = [(company, scenario, "revenue_growth", y, "ratio", g, "Approved", "Analyst Assumption") for y, g in zip(YEARS, GROWTH)]
    rows += [(company, scenario, "cogs_pct_revenue", y, "ratio", g, "Approved", "Analyst Assumption") for y, g in zip(YEARS, COGS)]
    rows += [(company, scenario, c, None, UNITS.get(c, "ratio"), v, "Approved", "Historical Driver") for c, v in DRIVERS.items()]
    return [r + (i,) for i, r in enumerate(rows)]


def typed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("value", F.col("value").cast("decimal(25,8)"))


def scenario_df(spark, rows=((1, "base", None, "Base"),)):
    return spark.createDataFrame(list(rows), "company_id bigint, scenario_id string, parent_id string, name string")


@pytest.fixture(scope="module")
def model(spark):
    return Model(typed(spark, ledger_rows(), LEDGER), scenario_df(spark), typed(spark, assumption_rows(), ASSUMPTION), YEARS)


EXPECTED = {
    "revenue": (1080.0, 1155.6, 1224.936, 1286.1828, 1337.630112), "ebit": (185.76, 201.0744, 215.588736, 228.940538, 240.773420), "net_income": (127.4976, 140.048544, 151.991439, 163.050809, 172.955799),
    "ppe_net": (538.4, 578.978, 620.74958, 662.686337, 703.734548), "change_in_nwc": (11.162753, 10.541544, 9.660019, 8.523865, 7.149402), "cash": (250.985087, 312.465232, 385.075289, 469.222224, 565.061131),
    "retained_earnings": (364.74784, 490.79153, 627.583825, 774.329553, 929.989773), "total_assets": (1129.849862, 1251.181907, 1383.167712, 1524.719385, 1674.503811),
    "debt": (280, 260, 240, 220, 200), "fcff": (91.614847, 101.697, 112.415841, 123.534187, 134.790186), "taxes": (40.2624, 44.225856, 47.997297, 51.489729, 54.617621),
}


def test_golden_forecast(model):
    rows = model.forecast.orderBy("year").collect()
    assert [r.year for r in rows] == list(YEARS)
    for col, want in EXPECTED.items():
        for r, w in zip(rows, want):
            assert abs(float(r[col]) - w) < 1e-6, (col, r.year, r[col], w)
    for r in rows:
        assert r.total_assets == r.total_liabilities + r.total_equity


def test_golden_valuation(model):
    v = model.valuation.first()
    for col, want in (("wacc", 0.098265116279070), ("pv_explicit", 421.85835437), ("terminal_value", 1885.75338045), ("pv_terminal", 1180.18189351), ("enterprise_value", 1602.04024788),
                      ("equity_value", 1502.04024788), ("per_share", 15.02040248), ("terminal_share", 0.73667431)):
        assert abs(float(v[col]) - want) < 1e-6, (col, v[col])
    mid = V.value(model.dcf_years("mid_year")).first()
    assert abs(float(mid.enterprise_value) - 1678.90845943) < 1e-6 and abs(float(mid.per_share) - 15.78908459) < 1e-6
    assert "minority_interest" in v.assumed_nil


def test_sensitivity(model):
    g = {(float(r.wacc), float(r.terminal_growth)): r for r in V.sensitivity(model.dcf_years(), ("0.08", "0.10", "0.06"), ("0.015", "0.035", "0.07")).collect()}
    assert abs(float(g[(0.08, 0.015)].enterprise_value) - 1876.285838) < 1e-5
    assert abs(float(g[(0.10, 0.035)].enterprise_value) - 1752.530232) < 1e-5
    blocked = g[(0.06, 0.07)]
    assert blocked.enterprise_value is None and blocked.note


def test_thirteen_checks_pass(model):
    got = {r.check_name: r.status for r in model.checks.collect()}
    assert len(got) == 13 and set(got.values()) == {"PASS"}, got


def test_a_corrupted_figure_fails_and_is_not_plugged(spark, model):
    rows = [(c, s, a, y, "999" if (a, y) == ("cash", 2025) else v) for c, s, a, y, v in ledger_rows()]
    bad = Model(typed(spark, rows, LEDGER), model.scenarios, model.assumptions, YEARS)
    got = {r.check_name: r for r in bad.checks.collect()}
    assert got["historical balance sheet balances"].status == "FAIL" and "2025" in got["historical balance sheet balances"].detail
    assert got["historical cash flow reconciles"].status == "FAIL"
    assert got["forecast balance sheet balances"].status == "FAIL"


def test_missing_driver_and_missing_balance_block(spark, model):
    short = typed(spark, [r for r in assumption_rows() if r[2] != "tax_rate"], ASSUMPTION)
    s = Model(model.ledger, model.scenarios, short, YEARS).status.first()
    assert not s.may_calculate and "tax_rate: missing" in s.blocked_by
    gap = typed(spark, [r for r in ledger_rows() if r[2] != "other_current_assets"], LEDGER)
    s = Model(gap, model.scenarios, model.assumptions, YEARS).status.first()
    assert not s.may_calculate and "other_current_assets" in s.blocked_by


def test_period_specific_ancestor_beats_general_override(spark):
    sc = scenario_df(spark, [(1, "base", None, "Base"), (1, "upside", "base", "Upside")])
    a = typed(spark, [(1, "base", "revenue_growth", 2027, "ratio", "0.07", "Approved", "x", 0), (1, "upside", "revenue_growth", None, "ratio", "0.12", "Approved", "x", 1)], ASSUMPTION)
    got = {(r.scenario_id, r.year): r.value for r in S.resolve(sc, a, (2027, 2028)).collect()}
    assert got[("upside", 2027)] == Decimal("0.07") and got[("upside", 2028)] == Decimal("0.12")
    assert ("base", 2028) not in got


def test_circular_and_unknown_parents_are_named(spark):
    sc = scenario_df(spark, [(1, "base", None, "B"), (1, "a", "b", "A"), (1, "b", "a", "B2"), (1, "c", "zz", "C"), (2, "base", None, "B")])
    got = {(r.company_id, r.scenario_id): r.problem for r in S.tree_violations(sc).collect()}
    assert got[(1, "a")] == "circular inheritance" and got[(1, "b")] == "circular inheritance" and got[(1, "c")] == "unknown parent" and len(got) == 3


MERIDIAN = {
    ("income", "revenue"): (1100000, 1250000), ("income", "cogs"): (660000, 750000), ("income", "operating_expenses"): (270000, 300000), ("income", "interest_expense"): (20000, 18000), ("income", "taxes"): (37500, 45500),
    ("balance", "cash"): (142000, 164500), ("balance", "accounts_receivable"): (180500, 205000), ("balance", "inventory"): (155000, 160000), ("balance", "ppe_net"): (588000, 620000),
    ("balance", "accounts_payable"): (121000, 130000), ("balance", "debt"): (425000, 400000), ("balance", "common_equity"): (50000, 50000), ("balance", "retained_earnings"): (469500, 569500),
    ("cashflow", "depreciation_amortization"): (68000, 75000), ("cashflow", "change_in_nwc"): (-15000, -20500), ("cashflow", "capex"): (-95000, -107000), ("cashflow", "debt_repayment"): (-20000, -25000), ("cashflow", "dividends"): (-30000, -36500),
}


def test_historical_schedules(spark):
    rows = [(7, s, a, y, str(v)) for (s, a), vs in MERIDIAN.items() for y, v in zip((2024, 2025), vs)]
    w = L.fill_derivable(L.to_wide(typed(spark, rows, LEDGER)))
    days = {(r.year, r.driver): float(r.days) for r in H.days_drivers(w).collect()}
    assert [days[(2024, d)] for d in ("dso", "inventory_days", "dpo")] == [59.9, 85.7, 66.9]
    assert [days[(2025, d)] for d in ("dso", "inventory_days", "dpo")] == [59.9, 77.9, 63.3]
    wc = {r.year: r for r in H.working_capital(w).collect()}
    assert wc[2024].nwc == 214500 and wc[2025].nwc == 235000
    assert H.nwc_reconcile(w).first().unexplained == 0
    roll = {r.schedule: r for r in H.rollforward(w).collect()}
    assert roll["ppe"].computed_ending == 620000 and roll["ppe"].unexplained == 0
    assert roll["debt"].computed_ending == 400000 and roll["debt"].absent == ["Borrowing"]
    assert roll["retained_earnings"].computed_ending == 569500
    assert roll["common_equity"].computed_ending == 50000 and roll["intangibles"].computed_ending is None


def test_absent_is_never_zero(spark):
    rows = [(1, "income", "revenue", 2025, "10"), (1, "cashflow", "other_operating", 2025, "5")]
    w = L.fill_derivable(L.to_wide(typed(spark, rows, LEDGER))).first()
    assert w.is_gross_profit is None and w.cf_cash_flow_from_operations is None and w.is_operating_expenses is None and w.is_ebitda is None


def test_grid_centre_is_the_valuation_for_every_convention(spark):
    from ledgerspan.operators import valuation as V
    from ledgerspan.plans.q_model import model

    m = model(spark, "/root/testdata/sf0.001")
    for convention, kw in (("year_end", {}), ("mid_year", {}), ("exact_date", {"valuation_date": "2001-06-30"})):
        years = m.dcf_years(convention, **kw)
        value = {(r.company_id, r.scenario_id): r for r in V.value(years).where("enterprise_value IS NOT NULL").collect()}
        cells = V.centred_grid(years).collect()
        centre = [c for c in cells if (c.company_id, c.scenario_id) in value and c.wacc == value[c.company_id, c.scenario_id].wacc and c.terminal_growth == value[c.company_id, c.scenario_id].terminal_growth]
        assert len(centre) == len(value) > 0
        for c in centre:
            v = value[c.company_id, c.scenario_id]
            assert abs(c.enterprise_value - v.enterprise_value) <= abs(v.enterprise_value) * Decimal("1e-9")


def test_flow_before_the_valuation_date_is_refused(spark):
    from ledgerspan.operators import valuation as V
    from ledgerspan.plans.q_model import model

    years = model(spark, "/root/testdata/sf0.001").dcf_years("exact_date", valuation_date="2003-06-30")
    rows = V.value(years).collect()
    assert rows and all(r.enterprise_value is None and r.blocked_by for r in rows)
    assert any("before the valuation date" in r.blocked_by for r in rows)


def test_repeated_scenario_is_reported_and_does_not_stop_the_rest(spark):
    from ledgerspan.operators import scenarios as S

    rows = [(1, "base", None), (1, "upside", "base"), (1, "upside", "other"), (2, "base", None), (2, "down", "base")]
    df = spark.createDataFrame(rows, "company_id long, scenario_id string, parent_id string")
    assert {(r.company_id, r.scenario_id, r.problem) for r in S.tree_violations(df).collect()} == {(1, "upside", "repeated scenario id")}
    assert {(r.company_id, r.scenario_id) for r in S.scenario_lineage(df).collect()} == {(1, "base"), (1, "upside"), (2, "base"), (2, "down")}


def test_drivers_follow_each_company_s_own_last_year(spark, tmp_path):
    from datetime import date

    from ledgerspan.sources import derived as D

    line = lambda s, y: (s, 1, date(y, 5, 1), 100.0 * s, 0.05, 0.02, 3.0, "N", "O")
    spark.createDataFrame([line(1, 1999), line(1, 2000), line(2, 2001)], "l_suppkey long, l_partkey long, l_shipdate date, l_extendedprice double, l_discount double, l_tax double, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 9.0)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.company_id for r in D.assumptions(spark, str(tmp_path)).select("company_id").distinct().collect()} == {1, 2}
