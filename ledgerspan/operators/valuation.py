"""Discounted cash flow, equity bridge and sensitivity for every company and scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..money import FACTOR, MONEY
from .ledger import stacked

K = ("company_id", "scenario_id")
R = "decimal(12,8)"
W = "decimal(20,16)"
TERMINAL_SHARE_LIMIT = "0.75"
NARROW_HEADROOM = "0.02"
ZERO = f"CAST(0 AS {MONEY})"


def timing(convention: str = "year_end", valuation_date: str | None = None, fiscal_year_end: tuple[int, int] = (12, 31)) -> str:
    """SQL for the time fraction of each year; `n` is its ordinal."""
    if convention == "year_end":
        return "CAST(n AS DECIMAL(20,16))"
    if convention == "mid_year":
        return "CAST(n - 0.5 AS DECIMAL(20,16))"
    if convention != "exact_date" or valuation_date is None:
        raise ValueError("exact_date timing needs a valuation date")
    return f"CAST(datediff({year_end_date('year', fiscal_year_end)}, DATE'{valuation_date}') / CAST(365 AS DECIMAL(20,15)) AS DECIMAL(20,16))"


def year_end_date(year: str, fiscal_year_end: tuple[int, int]) -> str:
    """Fiscal year end in a year; 29 February falls back to the 28th in a common year."""
    m, d = fiscal_year_end
    if (m, d) == (2, 29):
        return f"last_day(make_date({year}, 2, 1))"
    return f"make_date({year}, {m}, {d})"


def factor(rate: str, t: str) -> str:
    """1 / (1 + rate)^t: repeated multiplication for whole t, exp/ln otherwise; NULL for a negative t."""
    power = (
        f"aggregate(slice(sequence(0, CAST({t} AS INT)), 2, CAST({t} AS INT) + 1), CAST(1 AS {FACTOR}),"
        f" (a, i) -> CAST(a * CAST(1 + {rate} AS DECIMAL(16,14)) AS {FACTOR}))"
    )
    return (
        f"CASE WHEN {t} < 0 THEN NULL WHEN {t} = floor({t}) THEN CAST(1 / {power} AS {FACTOR})"
        f" ELSE CAST(exp(-CAST({t} AS DOUBLE) * ln(1 + CAST({rate} AS DOUBLE))) AS {FACTOR}) END"
    )


MARKET = [c for c, *_ in dims.MARKET_INPUTS]
_COC = ["cost_of_equity", "after_tax_debt", "weight_equity", "weight_debt", "wacc"]


def cost_of_capital(fc: DataFrame) -> DataFrame:
    """Adds CAPM, after-tax debt, weights and WACC to forecast rows, from the inputs each row carries.
    The tax rate is the final forecast year's."""
    return (
        fc.selectExpr("* EXCEPT (mk)", *[f"mk.m_{c} AS m_{c}" for c in MARKET])
        .selectExpr(
            "*",
            f"CAST(CAST(m_risk_free_rate AS {R}) + CAST(m_beta AS {R}) * CAST(m_equity_risk_premium AS {R}) AS {W}) AS cost_of_equity",
            f"CAST(CAST(m_pretax_cost_of_debt AS {R}) * (1 - CAST(final_tax_rate AS {R})) AS {W}) AS after_tax_debt",
            f"CAST(try_divide(m_market_value_equity, m_market_value_equity + m_market_value_debt) AS {FACTOR}) AS weight_equity",
            f"CAST(try_divide(m_market_value_debt, m_market_value_equity + m_market_value_debt) AS {FACTOR}) AS weight_debt",
        )
        .selectExpr("*", f"CAST(weight_equity * cost_of_equity + weight_debt * after_tax_debt AS {W}) AS wacc")
    )


def cost_of_capital_table(fc: DataFrame) -> DataFrame:
    """One row per company and scenario."""
    return cost_of_capital(fc).groupBy(*K).agg(*[F.first(c).alias(c) for c in _COC + ["final_tax_rate"] + [f"m_{c}" for c in MARKET]])


def contract_violations(cc: DataFrame) -> DataFrame:
    """Range rules on the inputs of a valuation."""
    rules = [
        ("market_value_equity must be positive", "m_market_value_equity <= 0"),
        ("market_value_debt cannot be negative", "m_market_value_debt < 0"),
        ("tax_rate must be in [0, 1)", "final_tax_rate < 0 OR final_tax_rate >= 1"),
        ("diluted_shares must be positive", "m_diluted_shares <= 0"),
    ]
    rows = [(f"'{n}'", f"coalesce({e}, false)") for n, e in rules]
    return cc.selectExpr(*K, stacked(rows, ("rule", "broken"))).where("broken").drop("broken")


def dcf_years(fc: DataFrame, convention: str = "year_end", **kw) -> DataFrame:
    """Per forecast year: FCFF, time fraction, discount factor and present value."""
    t = timing(convention, **kw)
    keep = ["year", "ebit", "tax_rate", "depreciation", "capex", "change_in_nwc", "fcff", "b_cash", "b_debt", "unusable"]
    return (
        cost_of_capital(fc)
        .selectExpr(*K, *keep, *_COC, *[f"m_{c}" for c in MARKET], "row_number() OVER (PARTITION BY company_id, scenario_id ORDER BY year) AS n")
        .selectExpr("*", f"{t} AS t")
        .selectExpr("*", f"{factor('wacc', 't')} AS discount_factor")
        .selectExpr("*", f"CAST(fcff * discount_factor AS {MONEY}) AS present_value")
    )


def value(years: DataFrame) -> DataFrame:
    """Enterprise value, equity bridge and per-share value; blocked scenarios keep their reason."""
    g = years.groupBy(*K).agg(
        F.sum("present_value").cast(MONEY).alias("pv_explicit"),
        F.max_by("fcff", "year").alias("last_fcff"),
        F.max_by("discount_factor", "year").alias("last_factor"),
        F.min("t").alias("first_t"),
        *[F.first(c).alias(c) for c in ("b_cash", "b_debt", "wacc", "cost_of_equity", "after_tax_debt", "weight_equity", "weight_debt", "unusable")],
        *[F.first(f"m_{c}").alias(f"m_{c}") for c, *_ in dims.MARKET_INPUTS],
    )
    bridge = [c for c, _, _, grp in dims.MARKET_INPUTS if grp == "bridge" and c != "diluted_shares"]
    nil = "array_compact(array(" + ", ".join(f"CASE WHEN m_{c} IS NULL THEN '{c}' END" for c in bridge) + "))"
    n = {c: f"coalesce(m_{c}, {ZERO})" for c in bridge}
    return (
        g.selectExpr(
            "*",
            "CAST(m_terminal_growth AS decimal(12,8)) AS terminal_growth",
            f"{nil} AS assumed_nil",
            "CASE WHEN size(unusable) > 0 THEN array_join(unusable, ', ') WHEN first_t < 0 THEN 'cash flow before the valuation date'"
            " WHEN m_terminal_growth IS NULL THEN 'terminal_growth not supplied' WHEN wacc IS NULL THEN 'cost of capital not supplied'"
            " WHEN wacc <= m_terminal_growth THEN 'WACC at or below terminal growth' END AS blocked_by",
        )
        .selectExpr(
            "*",
            f"CASE WHEN blocked_by IS NULL THEN CAST(CAST(last_fcff * (1 + terminal_growth) AS {MONEY}) / (wacc - terminal_growth) AS {MONEY}) END AS terminal_value",
        )
        .selectExpr("*", f"CAST(terminal_value * last_factor AS {MONEY}) AS pv_terminal")
        .selectExpr("*", f"CAST(pv_explicit + pv_terminal AS {MONEY}) AS enterprise_value")
        .selectExpr(
            "*",
            f"CAST(enterprise_value + b_cash - b_debt + {n['non_operating_investments']} - {n['minority_interest']} - {n['preferred_stock']}"
            f" - {n['pension_obligations']} - {n['other_claims']} AS {MONEY}) AS equity_value",
        )
        .selectExpr(
            "*",
            f"CAST(try_divide(equity_value, m_diluted_shares) AS {MONEY}) AS per_share",
            f"CAST(try_divide(pv_terminal, enterprise_value) AS DECIMAL(20,16)) AS terminal_share",
            "CAST(wacc - terminal_growth AS decimal(20,16)) AS headroom",
        )
        .selectExpr(
            "*",
            f"coalesce(terminal_share > {TERMINAL_SHARE_LIMIT}, false) AS terminal_warning",
            f"CASE WHEN headroom <= 0 THEN 'blocked' WHEN headroom < {NARROW_HEADROOM} THEN 'narrow' WHEN headroom IS NOT NULL THEN 'ok' END AS headroom_state",
        )
    )


def bridge_lines(v: DataFrame) -> DataFrame:
    """The walk from enterprise to equity value, one signed line per row."""
    rows = [("1", "'enterprise_value'", "enterprise_value"), ("2", "'cash'", "b_cash"), ("3", "'debt'", "-b_debt")]
    signs = {"non_operating_investments": "", "minority_interest": "-", "preferred_stock": "-", "pension_obligations": "-", "other_claims": "-"}
    rows += [(str(4 + i), f"'{c}'", f"{s}coalesce(m_{c}, {ZERO})") for i, (c, s) in enumerate(signs.items())]
    rows += [("9", "'equity_value'", "equity_value")]
    rows = [(o, n, f"CAST({e} AS {MONEY})") for o, n, e in rows]
    return v.where("enterprise_value IS NOT NULL").selectExpr(*K, stacked(rows, ("ordinal", "line", "amount")))


def _cells(base: DataFrame) -> DataFrame:
    """Each cell discounts at the time fractions of its own flows, whatever the timing convention."""
    pv = f"aggregate(flows, {ZERO}, (a, f) -> CAST(a + CAST(f.fcff * {factor('w', 'f.t')} AS {MONEY}) AS {MONEY}))"
    last = "element_at(flows, -1)"
    tv = f"CAST(CAST({last}.fcff * (1 + CAST(g AS {R})) AS {MONEY}) / (w - g) AS {MONEY})"
    pvt = f"CAST({tv} * {factor('w', f'{last}.t')} AS {MONEY})"
    return (
        base.selectExpr(
            *K, "w AS wacc", "g AS terminal_growth", "claims", "shares",
            f"CASE WHEN flows[0].t < 0 THEN 'cash flow before the valuation date' WHEN beta = 0 THEN 'beta is zero' WHEN we <= 0 THEN 'no equity weight' WHEN w <= g THEN 'n/a: WACC <= g' END AS note",
            f"CASE WHEN w > g AND beta <> 0 AND we > 0 THEN CAST({pv} + {pvt} AS {MONEY}) END AS enterprise_value",
        )
        .selectExpr("*", f"CAST(enterprise_value + claims AS {MONEY}) AS equity_value")
        .selectExpr(*K, "wacc", "terminal_growth", "note", "enterprise_value", "equity_value", f"CAST(try_divide(equity_value, shares) AS {MONEY}) AS per_share")
    )


def _flow_base(years: DataFrame) -> DataFrame:
    claims = "b_cash - b_debt" + "".join(
        f" {s} coalesce(m_{c}, {ZERO})"
        for c, s in (("non_operating_investments", "+"), ("minority_interest", "-"), ("preferred_stock", "-"), ("pension_obligations", "-"), ("other_claims", "-"))
    )
    return years.groupBy(*K).agg(
        F.expr("array_sort(collect_list(struct(t, fcff)))").alias("flows"),
        F.first("wacc").alias("base_wacc"),
        F.first(F.expr(f"CAST(m_terminal_growth AS {R})")).alias("base_growth"),
        F.first(F.expr(f"CAST({claims} AS {MONEY})")).alias("claims"),
        F.first("m_diluted_shares").alias("shares"),
        F.first("m_beta").alias("beta"),
        F.first("weight_equity").alias("we"),
    )


def sensitivity(years: DataFrame, wacc_axis: Sequence[str], growth_axis: Sequence[str]) -> DataFrame:
    """Fixed axes; the cells of a scenario come from its own row, so no join and no shuffle."""
    ws = "array(" + ", ".join(f"CAST({w} AS {W})" for w in wacc_axis) + ")"
    gs = "array(" + ", ".join(f"CAST({g} AS {W})" for g in growth_axis) + ")"
    b = _flow_base(years).selectExpr("*", f"explode({ws}) AS w").selectExpr("*", f"explode({gs}) AS g")
    return _cells(b)


def centred_grid(years: DataFrame, step: str = "0.0025", each_way: int = 2) -> DataFrame:
    """Axes centred on each scenario's own WACC and growth."""
    offs = f"sequence(-{each_way}, {each_way})"
    b = (
        _flow_base(years).where("base_wacc IS NOT NULL AND base_growth IS NOT NULL")
        .selectExpr("*", f"explode(transform({offs}, i -> CAST(base_wacc + i * CAST({step} AS {R}) AS {W}))) AS w")
        .selectExpr("*", f"explode(transform({offs}, i -> CAST(base_growth + i * CAST({step} AS {R}) AS {W}))) AS g")
    )
    return _cells(b)


def grid_table(cells: DataFrame, growth_axis: Sequence[str]) -> DataFrame:
    """WACC rows by growth columns."""
    return cells.groupBy(*K, "wacc").pivot("terminal_growth", [str(g) for g in growth_axis]).agg(F.first("enterprise_value"))
