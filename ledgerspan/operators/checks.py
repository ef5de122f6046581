"""Checks: one row per company (and scenario) and check, with PASS, FAIL or SKIP and a detail.

Every year-level comparison becomes one row of a stacked projection, so a whole panel costs a
single aggregation over the model rows. A check with nothing comparable is SKIP, never PASS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..money import ABS_FLOOR, MONEY, REL_TOLERANCE, SUBTOTAL_REL_TOLERANCE, close
from . import forecast as FC
from . import valuation as V
from .ledger import by_year, signed_sum, stacked, with_prior

ZERO = f"CAST(0 AS {MONEY})"


def close_sql(a: str, b: str, rel: str = REL_TOLERANCE, floor: str = ABS_FLOOR) -> str:
    return (
        f"abs(({a}) - ({b})) <= greatest(greatest(abs({a}), abs({b})) * CAST('{rel}' AS DECIMAL(10,9)), CAST('{floor}' AS DECIMAL(10,9)))"
    )


def cash_rollforward_rows(wide: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Opening cash plus the three flow subtotals against closing cash, consecutive years only."""
    w = by_year(keys)
    d = wide.withColumns({"prev_year": F.lag("year").over(w), "opening": F.lag("bs_cash").over(w)})
    flows = F.col("cf_cash_flow_from_operations") + F.col("cf_cash_flow_from_investing") + F.col("cf_cash_flow_from_financing")
    return (
        d.where(F.col("year") == F.col("prev_year") + 1)
        .withColumns({"closing": F.col("bs_cash"), "expected": (F.col("opening") + flows).cast(MONEY)})
        .where(F.col("expected").isNotNull() & F.col("closing").isNotNull())
        .withColumn("agrees", close(F.col("expected"), F.col("closing")))
    )


_FLOWS = "cf_cash_flow_from_operations + cf_cash_flow_from_investing + cf_cash_flow_from_financing"


def historical_comparisons() -> list[tuple[str, str, str, str]]:
    """(check, left, right, relative tolerance) over a filled row with prev_bs_cash and rep_ columns."""
    out = [
        ("historical balance sheet balances", "bs_total_assets", "bs_total_liabilities + bs_total_equity", REL_TOLERANCE),
        ("historical cash flow reconciles", f"prev_bs_cash + {_FLOWS}", "bs_cash", REL_TOLERANCE),
        ("net income linkage", "is_net_income", "cf_net_income", REL_TOLERANCE),
    ]
    out += [("reported subtotals reconcile", f"rep_{t}", signed_sum(s, p, m), SUBTOTAL_REL_TOLERANCE) for t, (s, p, m) in dims.DERIVATIONS.items()]
    return out


def forecast_comparisons() -> list[tuple[str, str, str, str]]:
    """The same over forecast rows, whose prev_ columns start from the opening balances."""
    sub = lambda *terms: " + ".join(terms)
    return [
        (n, a, b, REL_TOLERANCE)
        for n, a, b in (
            ("forecast balance sheet balances", "bs_total_assets", "bs_total_liabilities + bs_total_equity"),
            ("net income linkage", "is_net_income", "cf_net_income"),
            ("PP&E schedule linkage", "prev_ppe - cf_capex - cf_depreciation_amortization - x_disposals", "bs_ppe_net"),
            ("debt schedule linkage", "prev_debt + cf_debt_issuance + cf_debt_repayment", "bs_debt"),
            ("retained earnings linkage", "prev_re + is_net_income + cf_dividends", "bs_retained_earnings"),
            ("ending cash linkage", f"prev_cash + {_FLOWS}", "bs_cash"),
            ("FCFF matches the statements", "x_fcff",
             f"is_ebit - CAST(is_ebit * CAST(x_tax_rate AS DECIMAL(12,8)) AS {MONEY}) + cf_depreciation_amortization + cf_capex + cf_change_in_nwc"),
            ("forecast cash flow subtotals", "cf_cash_flow_from_operations", sub(*[f"coalesce(cf_{i}, {ZERO})" for i in dims.OPERATING_ITEMS])),
            ("forecast cash flow subtotals", "cf_cash_flow_from_investing", sub(*[f"coalesce(cf_{i}, {ZERO})" for i in dims.INVESTING_ITEMS])),
            ("forecast cash flow subtotals", "cf_cash_flow_from_financing", sub(*[f"coalesce(cf_{i}, {ZERO})" for i in dims.FINANCING_ITEMS])),
        )
    ]


MODEL_CHECKS = tuple(dict.fromkeys(c[0] for c in historical_comparisons() + forecast_comparisons())) + ("no forecast hardcodes", "WACC above terminal growth")


def tally(rows: DataFrame, items: Sequence[tuple[str, str, str, str]], keys: Sequence[str], extra: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Compared and broken counts per check, with the breaks listed by year."""
    cells = list(extra) + [(f"'{n}'", close_sql(a, b, rel), f"CAST(({a}) - ({b}) AS {MONEY})") for n, a, b, rel in items]
    return (
        rows.selectExpr(*keys, "year", stacked(cells, ("check_name", "ok", "difference")))
        .groupBy(*keys, "check_name")
        .agg(
            F.count_if(F.col("ok").isNotNull()).alias("compared"),
            F.count_if(~F.col("ok")).alias("broken"),
            F.collect_list(F.when(~F.col("ok"), F.concat("year", F.lit(": out by "), F.format_number("difference", 4)))).alias("breaks"),
        )
    )


def verdict(tallies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PASS, FAIL or SKIP per check; a check split over several tallies is added up first."""
    return (
        tallies.groupBy(*keys, "check_name")
        .agg(F.sum("compared").alias("compared"), F.sum("broken").alias("broken"), F.array_sort(F.flatten(F.collect_list("breaks"))).alias("breaks"))
        .selectExpr(
            *keys, "check_name",
            "CASE WHEN compared = 0 THEN 'SKIP' WHEN broken > 0 THEN 'FAIL' ELSE 'PASS' END AS status",
            "compared", "broken",
            "CASE WHEN compared = 0 THEN 'nothing to compare' WHEN broken > 0 THEN array_join(breaks, '; ') ELSE concat(compared, ' compared') END AS detail",
        )
    )


def historical_tally(filled: DataFrame) -> DataFrame:
    return tally(with_prior(filled, ["bs_cash"]), historical_comparisons(), ("company_id",))


def historical_checks(filled: DataFrame) -> DataFrame:
    """Balance, cash, subtotals and linkage over the reported years only."""
    return verdict(historical_tally(filled), ("company_id",))


def forecast_tally(fc: DataFrame) -> DataFrame:
    """Every forecast-year check of a scenario from its own rows, in one aggregation."""
    over = "OVER (PARTITION BY company_id, scenario_id ORDER BY year)"
    prev = [f"coalesce(lag({c}) {over}, b_{c}) AS prev_{n}" for c, n in (("cash", "cash"), ("ppe_net", "ppe"), ("debt", "debt"), ("retained_earnings", "re"))]
    driven = f"forall(array({', '.join(b for *_, b in FC.LINES)}), b -> trim(b) <> '') AS x_driven"
    first = "year = last_actual + 1"
    rows = FC.as_wide(
        V.cost_of_capital(fc), *prev, f"coalesce(ppe_disposals, {ZERO}) AS x_disposals", "tax_rate AS x_tax_rate", "fcff AS x_fcff", driven,
        f"CASE WHEN {first} THEN wacc END AS x_wacc", f"CASE WHEN {first} THEN m_terminal_growth END AS x_growth",
    )
    extra = [
        ("'no forecast hardcodes'", "coalesce(x_driven, false)", ZERO),
        ("'WACC above terminal growth'", "x_wacc > x_growth", f"CAST(x_wacc - x_growth AS {MONEY})"),
    ]
    return tally(rows, forecast_comparisons(), FC.K, extra)


def hardcode_check(fc_long: DataFrame) -> DataFrame:
    return fc_long.groupBy("company_id", "scenario_id").agg(F.count_if(F.col("origin") == "reported").alias("broken"), F.count("*").alias("compared")).selectExpr(
        "company_id", "scenario_id", "'no forecast hardcodes' AS check_name",
        "CASE WHEN broken > 0 THEN 'FAIL' ELSE 'PASS' END AS status", "compared", "broken", "concat(broken, ' hardcoded cells') AS detail",
    )


def all_checks(filled: DataFrame, fc: DataFrame, prepared: DataFrame) -> DataFrame:
    """The 13-line model panel of every scenario that was forecast."""
    scen = prepared.where("blocked_by IS NULL").select(*FC.K)
    hist = scen.join(historical_tally(filled), "company_id")
    return verdict(hist.unionByName(forecast_tally(fc)), FC.K)


NEEDS_VALUATION = ("WACC above terminal growth", "FCFF matches the statements")


def forecast_readiness(checks: DataFrame, status: DataFrame) -> DataFrame:
    """Per company whether every scenario is forecast and passes every check that needs no valuation, and what stands in the way."""
    bad = checks.where(~F.col("check_name").isin(*NEEDS_VALUATION) & (F.col("status") != "PASS")).groupBy("company_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat("scenario_id", F.lit(": "), "check_name", F.lit(" "), "status"))), "; ").alias("open"))
    built = status.groupBy("company_id").agg(F.count(F.lit(1)).alias("scenarios"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("may_calculate"), F.col("scenario_id")))), ", ").alias("not_built"))
    return built.join(bad, "company_id", "left").withColumn("open", F.coalesce("open", F.lit(""))).withColumn("forecast_ready", (F.col("not_built") == "") & (F.col("open") == ""))


def counts(results: DataFrame, *by: str) -> DataFrame:
    """PASS, FAIL and SKIP counts with subtotals by the given columns."""
    return results.rollup(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIP")]
    )


def filtered(results: DataFrame, status: str | None = None, severity: Sequence[str] | None = None) -> DataFrame:
    out = results
    if status is not None:
        out = out.where(F.col("status") == status)
    if severity is not None:
        out = out.where(F.col("severity").isin(list(severity)))
    return out
