"""What a change of one assumption would move, before it is saved.

Which figures read a driver is a fixed graph over the forecast and valuation columns; its closure (some hundred names) says what a
change can reach. The two runs are one: the companies that change are doubled, every scenario once as it stands and once with
the change, only scenarios that inherit from the changed one are carried behind the resolution, and one pass of the model
gives both. Figures are compared per scenario, year and name; nothing that the change cannot reach is compared or returned.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cache

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..money import MONEY
from . import forecast as FC
from . import scenarios as S
from .ledger import stacked

K = FC.K
AFTER = "\u0001after"  # marks the second copy of a scenario; no id of a user holds a control character

# Figure -> what it reads: drivers, market inputs and other figures.
READS = {
    "revenue": "revenue_growth", "cogs": "revenue cogs_pct_revenue cogs_amount", "operating_expenses": "revenue opex_pct_revenue opex_amount", "ebit": "revenue cogs operating_expenses",
    "depreciation": "ppe_net depreciation_pct_beginning_ppe", "capex": "revenue capex_pct_revenue capex_amount", "ppe_net": "capex depreciation ppe_disposals", "accounts_receivable": "revenue dso",
    "inventory": "cogs inventory_days", "accounts_payable": "cogs dpo", "change_in_nwc": "accounts_receivable inventory accounts_payable revenue other_current_assets_pct_revenue other_current_liabilities_pct_revenue",
    "debt": "debt_issuance debt_repayment", "interest_expense": "debt interest_rate_on_debt", "pretax_income": "ebit interest_expense other_income_expense", "taxes": "pretax_income tax_rate",
    "net_income": "pretax_income taxes", "dividends": "net_income dividend_payout_ratio dividends_amount", "retained_earnings": "net_income dividends", "common_equity": "revenue sbc_pct_revenue share_repurchases",
    "cfo": "net_income depreciation revenue sbc_pct_revenue change_in_nwc other_operating", "cfi": "capex acquisitions ppe_disposals other_investing", "cff": "debt_issuance debt_repayment share_repurchases dividends other_financing",
    "cash": "cfo cfi cff", "total_assets": "cash accounts_receivable inventory revenue other_current_assets_pct_revenue ppe_net other_investing",
    "total_liabilities": "accounts_payable revenue other_current_liabilities_pct_revenue debt other_operating other_financing", "total_equity": "common_equity retained_earnings",
    "fcff": "ebit tax_rate depreciation capex change_in_nwc", "cost_of_equity": "risk_free_rate beta equity_risk_premium", "after_tax_debt": "pretax_cost_of_debt tax_rate",
    "wacc": "cost_of_equity after_tax_debt market_value_equity market_value_debt", "pv_explicit": "fcff wacc", "terminal_value": "fcff wacc terminal_growth", "pv_terminal": "terminal_value wacc",
    "enterprise_value": "pv_explicit pv_terminal", "equity_value": "enterprise_value non_operating_investments minority_interest preferred_stock pension_obligations other_claims", "per_share": "equity_value diluted_shares",
}
BY_YEAR = tuple(n for n in READS if n not in ("cost_of_equity", "after_tax_debt", "wacc", "pv_explicit", "terminal_value", "pv_terminal", "enterprise_value", "equity_value", "per_share"))
SINGLE = tuple(n for n in READS if n not in BY_YEAR)


@cache
def reaches(code: str) -> frozenset[str]:
    """Every figure that reads a driver or figure, directly or through others."""
    out: set[str] = set()
    ahead = [code]
    while ahead:
        name = ahead.pop()
        fresh = {n for n, reads in READS.items() if name in reads.split()} - out
        out |= fresh
        ahead += fresh
    return frozenset(out)


def closure(spark) -> DataFrame:
    """code, target: all of it, for every driver and market input."""
    codes = [d[0] for d in dims.DRIVERS] + [m[0] for m in dims.MARKET_INPUTS]
    return dims.local_table(spark, [(c, t) for c in codes for t in sorted(reaches(c))], "code string, target string")


def scenario_model(m) -> DataFrame:
    """Every figure of every scenario as it stands (L14): keys, year (0 for single figures), target, value, and why it is not available."""
    yearly = m.forecast.selectExpr(*K, "year", stacked([(f"'{c}'", f"CAST({c} AS {MONEY})") for c in BY_YEAR], ("target", "value"))).withColumn("reason", F.lit(None).cast("string"))
    priced = m.valuation.select(*K, F.col("blocked_by").alias("value_blocked"), *[F.col(c).cast(MONEY) for c in SINGLE])
    s = m.prepared.select(*K, "blocked_by").join(priced, list(K), "left")
    why = "coalesce(concat('forecast: ', blocked_by), concat('valuation: ', value_blocked), 'an input is not stated')"
    single = s.selectExpr(*K, "0 AS year", "blocked_by", "value_blocked", stacked([(f"'{c}'", c) for c in SINGLE], ("target", "value"))).selectExpr(
        *K, "year", "target", "value", f"CASE WHEN value IS NULL THEN {why} END AS reason"
    )
    # a scenario that is not forecast has no years; each of its figures says so once
    stopped = s.where("blocked_by IS NOT NULL").selectExpr(*K, "0 AS year", "blocked_by", stacked([(f"'{c}'",) for c in BY_YEAR], ("target",))).selectExpr(
        *K, "year", "target", f"CAST(NULL AS {MONEY}) AS value", "concat('forecast: ', blocked_by) AS reason"
    )
    return yearly.unionByName(single).unionByName(stopped)


def doubled(m, changes: DataFrame):
    """A model of the changed companies alone, every scenario twice: as it stands, and with the changes."""
    ids = changes.select("company_id").distinct()
    only = lambda df: df.join(ids, "company_id", "left_semi")
    twice = lambda c: F.concat(F.col(c), F.lit(AFTER))
    scen = only(m.scenarios)
    scen = scen.unionByName(scen.withColumns({"scenario_id": twice("scenario_id"), "parent_id": twice("parent_id")}))
    before = only(m.assumptions)
    on = ["company_id", "scenario_id", "code"]
    new = changes.select(*on, F.col("value").alias("proposed"))
    after = before.join(new, on, "left").withColumn("value", F.coalesce("proposed", "value")).drop("proposed").withColumn("scenario_id", twice("scenario_id"))
    return replace(m, ledger=only(m.ledger), scenarios=scen, assumptions=before.unionByName(after))


def preview(m, changes: DataFrame) -> DataFrame:
    """company_id, scenario_id, code, year, target, before, after, state (moved, same, unavailable), reason.

    changes: company_id, scenario_id, code, value; one change per company, of an assumption that the scenario itself states
    (others change nothing). Scenarios that do not inherit from the changed one are not returned."""
    spark = changes.sparkSession
    both = doubled(m, changes)
    # scenarios whose line of ancestors holds the changed one, in either copy
    own = F.split("scenario_id", AFTER)[0]
    touched = S.scenario_lineage(m.scenarios).join(changes.withColumnRenamed("scenario_id", "ancestor_id").select("company_id", "ancestor_id", "code"), ["company_id", "ancestor_id"]).select("company_id", "scenario_id", "code").distinct()
    prepared = both.prepared.withColumn("_own", own).join(touched.select("company_id", F.col("scenario_id").alias("_own")), ["company_id", "_own"], "left_semi").drop("_own")
    both.__dict__["prepared"] = prepared.select(both.prepared.columns)
    figures = scenario_model(both).withColumns({"run": F.when(F.contains("scenario_id", F.lit(AFTER)), "after").otherwise("before"), "scenario_id": own})
    # only what the change can reach goes into the comparison
    figures = figures.join(touched, list(K)).join(F.broadcast(closure(spark)), ["code", "target"])
    of = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c)))
    pairs = figures.groupBy(*K, "code", "year", "target").agg(of("before", "value").alias("before"), of("after", "value").alias("after"), of("after", "reason").alias("reason"))
    state = F.when(F.col("after").isNull(), "unavailable").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("moved")
    return pairs.withColumn("state", state)


def impact_summary(previewed: DataFrame) -> DataFrame:
    """How many of the dependent figures move, per scenario and changed code."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return previewed.groupBy(*K, "code").agg(F.count_distinct("target").alias("reaches"), n("moved"), n("same"), n("unavailable"))
