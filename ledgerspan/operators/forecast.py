"""Driver-based forecast of three linked statements for every company and scenario.

Two recurrences (revenue, PP&E) are folded over the few forecast years of a scenario; everything
else is row arithmetic and running sums over the same clustering, so one exchange per input feeds
the whole model. Each flow is rounded once and then only added, so assets equal liabilities plus
equity exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..money import MONEY
from . import periods as PD
from . import scenarios as S
from .ledger import stacked

K = ("company_id", "scenario_id")
REQUIRED_BASE = (
    ("is_revenue", "revenue"), ("bs_ppe_net", "ppe_net"), ("bs_debt", "debt"), ("bs_retained_earnings", "retained_earnings"),
    ("bs_cash", "cash"), ("bs_common_equity", "common_equity"), ("bs_other_noncurrent_assets", "other_noncurrent_assets"),
    ("bs_other_noncurrent_liabilities", "other_noncurrent_liabilities"), ("bs_accounts_receivable", "accounts_receivable"),
    ("bs_inventory", "inventory"), ("bs_other_current_assets", "other_current_assets"), ("bs_accounts_payable", "accounts_payable"),
    ("bs_other_current_liabilities", "other_current_liabilities"),
)
CARRIED = ("goodwill", "intangibles", "lease_liabilities", "minority_interest")
ZERO = f"CAST(0 AS {MONEY})"
R = "decimal(12,8)"


def mul(amount: str, factor: str) -> str:
    return f"CAST({amount} * CAST({factor} AS {R}) AS {MONEY})"


def opening_balances(wide: DataFrame) -> DataFrame:
    """The last actual period of each company as b_<account>, with the required lines it lacks and all its actual years."""
    cols = [f"{c} AS b_{n}" for c, n in REQUIRED_BASE] + [f"bs_{a} AS b_{a}" for a in CARRIED]
    missing = "array_compact(array(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{n}' END" for c, n in REQUIRED_BASE) + "))"
    last = "row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS recency"
    actual = "array_sort(collect_list(year) OVER (PARTITION BY company_id)) AS actual_years"
    return wide.selectExpr("company_id", "year AS last_actual", *cols, f"{missing} AS missing_base", last, actual).where("recency = 1").drop("recency")


def forecast_periods(wide: DataFrame, count: int = 5) -> DataFrame:
    """Forecast years right after each company's last actual one."""
    return wide.groupBy("company_id").agg(F.max("year").alias("last_actual")).selectExpr(
        "company_id", f"explode(sequence(last_actual + 1, last_actual + {count})) AS year"
    )


_DRIVER_COLS = [d[0] for d in dims.DRIVERS]
MARKET_CODES = [m[0] for m in dims.MARKET_INPUTS]


def prepare(resolved_all: DataFrame, scenarios: DataFrame, opening: DataFrame, years: PD.Axis) -> DataFrame:
    """One row per company and scenario with its opening balances, the array of its forecast years,
    its market inputs, and what blocks it. Everything a scenario needs meets in one company-keyed join.
    The forecast years are those stated, or that many after each company's last actual one; an axis with a gap blocks."""
    state = S.driver_state(resolved_all).selectExpr("*", f"{S.gate_problems()} AS problems")
    cell = ", ".join(["year"] + _DRIVER_COLS + ["tax_source"])
    market = ", ".join(f"m_{c}" for c in MARKET_CODES)
    bad = ", ".join(f"CASE WHEN bad_{c} IS NOT NULL THEN '{c}' END" for c in MARKET_CODES)
    absent = ", ".join(f"CASE WHEN m_{c} IS NULL THEN '{c}' END" for c, _, req, _ in sorted(dims.MARKET_INPUTS) if req)
    per = state.groupBy(*K).agg(
        F.expr(f"array_sort(collect_list(CASE WHEN year <> {S.NO_PERIOD} THEN struct({cell}) END)) AS ys"),
        F.expr(f"array_sort(array_distinct(flatten(collect_list(CASE WHEN year <> {S.NO_PERIOD} THEN transform(problems, p -> concat(p.choice, ': ', p.problem)) END)))) AS problems"),
        F.expr(f"max(CASE WHEN year = {S.NO_PERIOD} THEN struct({market}) END) AS mk"),
        F.expr(f"max(CASE WHEN year = {S.NO_PERIOD} THEN array_compact(array({bad})) END) AS unusable"),
        F.expr(f"max(CASE WHEN year = {S.NO_PERIOD} THEN array_compact(array({absent})) END) AS missing_inputs"),
    )
    step = f"CAST(s.debt + coalesce(y.debt_issuance, {ZERO}) - coalesce(y.debt_repayment, {ZERO}) AS {MONEY})"
    lowest_debt = (
        f"aggregate(ys, named_struct('debt', b_debt, 'low', b_debt), (s, y) -> named_struct('debt', {step}, 'low', least(s.low, {step})), s -> s.low)"
    )
    known = scenarios.select(*K).join(per, list(K), "left").join(opening, "company_id", "left")
    known = known.selectExpr("*", f"{PD.forecast_years(years)} AS forecast_years")
    return known.selectExpr(
        "*",
        "CASE WHEN missing_base IS NULL THEN 'no actual period'"
        f" WHEN {PD.problem()} IS NOT NULL THEN concat('periods: ', {PD.problem()})"
        " WHEN coalesce(size(ys), 0) < size(forecast_years) THEN 'drivers: no driver for some year'"
        " WHEN size(problems) > 0 THEN concat('drivers: ', array_join(problems, '; '))"
        " WHEN size(missing_base) > 0 THEN concat('opening balances: ', array_join(missing_base, ', '))"
        f" WHEN {lowest_debt} < 0 THEN 'debt: more is repaid than is outstanding' END AS blocked_by",
    )


def status(prepared: DataFrame) -> DataFrame:
    """Whether each scenario may calculate, and what blocks it."""
    return prepared.selectExpr(*K, "blocked_by", "blocked_by IS NULL AS may_calculate", "missing_inputs", "unusable")


def fold_revenue_and_ppe(prepared: DataFrame) -> DataFrame:
    """Rows per company, scenario and year with revenue, CapEx, depreciation and PP&E."""
    rev = mul("s.rev", "1 + y.revenue_growth")
    capex = f"coalesce(y.capex_amount, {mul(rev, 'y.capex_pct_revenue')})"
    dep = mul("s.ppe", "y.depreciation_pct_beginning_ppe")
    end = f"CAST(s.ppe + {capex} - {dep} - coalesce(y.ppe_disposals, {ZERO}) AS {MONEY})"
    cell = f"named_struct('revenue', {rev}, 'capex', {capex}, 'depreciation', {dep}, 'ppe_open', s.ppe, 'ppe_net', {end})"
    empty = f"CAST(array() AS ARRAY<STRUCT<revenue: {MONEY}, capex: {MONEY}, depreciation: {MONEY}, ppe_open: {MONEY}, ppe_net: {MONEY}>>)"
    fold = (
        f"aggregate(ys, named_struct('rev', b_revenue, 'ppe', b_ppe_net, 'out', {empty}),"
        f" (s, y) -> named_struct('rev', {rev}, 'ppe', {end}, 'out', concat(s.out, array({cell}))), s -> s.out)"
    )
    ok = prepared.where("blocked_by IS NULL")
    bs = [c for c in ok.columns if c.startswith("b_")]
    keep = [*K, "last_actual", *bs, "mk", "unusable", "element_at(ys, -1).tax_rate AS final_tax_rate"]
    names = [*K, "last_actual", *bs, "mk", "unusable", "final_tax_rate"]
    return (
        ok.selectExpr(*keep, "ys", f"{fold} AS f")
        .selectExpr(*names, "inline(arrays_zip(ys, f))")
        .selectExpr(*names, "ys.*", "f.*")
    )


def build(prepared: DataFrame) -> DataFrame:
    """The full forecast, one row per company, scenario and year, one column per line."""
    w = "OVER (PARTITION BY company_id, scenario_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    lagw = "OVER (PARTITION BY company_id, scenario_id ORDER BY year)"
    opt = lambda c: f"coalesce({c}, {ZERO})"
    d = fold_revenue_and_ppe(prepared)
    d = d.selectExpr(
        "*",
        f"coalesce(cogs_amount, {mul('revenue', 'cogs_pct_revenue')}) AS cogs",
        f"coalesce(opex_amount, {mul('revenue', 'opex_pct_revenue')}) AS operating_expenses",
        f"CAST(revenue * CAST(dso AS {R}) / 365 AS {MONEY}) AS accounts_receivable",
        f"{mul('revenue', 'other_current_assets_pct_revenue')} AS other_current_assets",
        f"{mul('revenue', 'other_current_liabilities_pct_revenue')} AS other_current_liabilities",
        f"CAST(b_debt + sum({opt('debt_issuance')} - {opt('debt_repayment')}) {w} AS {MONEY}) AS debt",
        f"{mul('revenue', f'coalesce(sbc_pct_revenue, {ZERO})')} AS stock_based_compensation",
    )
    d = d.selectExpr(
        "*",
        f"CAST(revenue - cogs AS {MONEY}) AS gross_profit",
        f"CAST(revenue - cogs - operating_expenses AS {MONEY}) AS ebit",
        f"CAST(cogs * CAST(inventory_days AS {R}) / 365 AS {MONEY}) AS inventory",
        f"CAST(cogs * CAST(dpo AS {R}) / 365 AS {MONEY}) AS accounts_payable",
        f"CAST(debt - {opt('debt_issuance')} + {opt('debt_repayment')} AS {MONEY}) AS debt_open",
    )
    d = d.selectExpr(
        "*",
        f"{mul('debt_open', 'interest_rate_on_debt')} AS interest_expense",
        f"CAST(accounts_receivable + inventory + other_current_assets - accounts_payable - other_current_liabilities AS {MONEY}) AS nwc",
    )
    b_nwc = "b_accounts_receivable + b_inventory + b_other_current_assets - b_accounts_payable - b_other_current_liabilities"
    d = d.selectExpr(
        "*",
        f"CAST(ebit - interest_expense + {opt('other_income_expense')} AS {MONEY}) AS pretax_income",
        f"CAST(nwc - coalesce(lag(nwc) {lagw}, {b_nwc}) AS {MONEY}) AS change_in_nwc",
    )
    d = d.selectExpr("*", f"{mul('pretax_income', 'tax_rate')} AS taxes")
    d = d.selectExpr("*", f"CAST(pretax_income - taxes AS {MONEY}) AS net_income")
    d = d.selectExpr(
        "*", f"coalesce(dividends_amount, {mul(f'greatest(net_income, {ZERO})', f'coalesce(dividend_payout_ratio, {ZERO})')}) AS dividends"
    )
    d = d.selectExpr(
        "*",
        f"CAST(net_income + depreciation + stock_based_compensation - change_in_nwc + {opt('other_operating')} AS {MONEY}) AS cfo",
        f"CAST(-capex - {opt('acquisitions')} + {opt('ppe_disposals')} + {opt('other_investing')} AS {MONEY}) AS cfi",
        f"CAST({opt('debt_issuance')} - {opt('debt_repayment')} - {opt('share_repurchases')} - dividends + {opt('other_financing')} AS {MONEY}) AS cff",
    )
    d = d.selectExpr(
        "*",
        f"CAST(b_cash + sum(cfo + cfi + cff) {w} AS {MONEY}) AS cash",
        f"CAST(b_retained_earnings + sum(net_income - dividends) {w} AS {MONEY}) AS retained_earnings",
        f"CAST(b_common_equity + sum(stock_based_compensation - {opt('share_repurchases')}) {w} AS {MONEY}) AS common_equity",
        f"CAST(b_other_noncurrent_assets - sum({opt('other_investing')}) {w} AS {MONEY}) AS other_noncurrent_assets",
        f"CAST(b_other_noncurrent_liabilities + sum({opt('other_operating')} + {opt('other_financing')}) {w} AS {MONEY}) AS other_noncurrent_liabilities",
        *[f"b_{a} AS {a}" for a in CARRIED],
    )
    total = lambda section: " + ".join(f"coalesce({a}, {ZERO})" for a in section)
    return d.selectExpr(
        "*",
        f"CAST({total(dims.ASSETS)} AS {MONEY}) AS total_assets",
        f"CAST({total(dims.LIABILITIES)} AS {MONEY}) AS total_liabilities",
        f"CAST({total(dims.EQUITY)} AS {MONEY}) AS total_equity",
        f"CAST({mul('ebit', '1 - tax_rate')} + depreciation - capex - change_in_nwc AS {MONEY}) AS fcff",
        f"CASE WHEN tax_source = {S.SOURCE_TYPES.index('Historical Driver') + 1} THEN 'historical_effective'"
        f" WHEN tax_source IN ({S.SOURCE_TYPES.index('Company Filing') + 1}, {S.SOURCE_TYPES.index('Company Guidance') + 1}) THEN 'statutory' ELSE 'normalized_effective' END AS tax_basis",
    )


def method_violations(drivers: DataFrame) -> DataFrame:
    """Lines with two stated methods."""
    both = [("cogs", "cogs_pct_revenue", "cogs_amount"), ("operating_expenses", "opex_pct_revenue", "opex_amount"),
            ("capex", "capex_pct_revenue", "capex_amount"), ("dividends", "dividend_payout_ratio", "dividends_amount")]
    rows = [(f"'{n}'", f"{p} IS NOT NULL AND {a} IS NOT NULL") for n, p, a in both]
    return drivers.selectExpr(*K, "year", stacked(rows, ("line", "both"))).where("both").drop("both")


# statement, account, amount, basis text
LINES = (
    ("income", "revenue", "revenue", "concat('revenue_growth = ', revenue_growth)"),
    ("income", "cogs", "cogs", "CASE WHEN cogs_amount IS NOT NULL THEN 'cogs_amount' ELSE concat('cogs_pct_revenue = ', cogs_pct_revenue) END"),
    ("income", "gross_profit", "gross_profit", "'revenue - cogs'"),
    ("income", "operating_expenses", "operating_expenses", "CASE WHEN opex_amount IS NOT NULL THEN 'opex_amount' ELSE concat('opex_pct_revenue = ', opex_pct_revenue) END"),
    ("income", "ebit", "ebit", "'revenue - cogs - operating_expenses'"),
    ("income", "interest_expense", "interest_expense", "concat('interest_rate_on_debt = ', interest_rate_on_debt, ' on opening debt')"),
    ("income", "other_income_expense", f"coalesce(other_income_expense, {ZERO})", "'other_income_expense'"),
    ("income", "pretax_income", "pretax_income", "'ebit - interest + other income'"),
    ("income", "taxes", "taxes", "concat(tax_basis, ' rate ', tax_rate)"),
    ("income", "net_income", "net_income", "'pretax - taxes'"),
    ("balance", "cash", "cash", "'opening cash + CFO + CFI + CFF'"),
    ("balance", "accounts_receivable", "accounts_receivable", "concat('dso = ', dso)"),
    ("balance", "inventory", "inventory", "'inventory_days on cogs'"),
    ("balance", "other_current_assets", "other_current_assets", "'other_current_assets_pct_revenue'"),
    ("balance", "ppe_net", "ppe_net", "'opening + capex - depreciation - disposals'"),
    ("balance", "goodwill", "goodwill", "'held at the last actual balance'"),
    ("balance", "intangibles", "intangibles", "'held at the last actual balance'"),
    ("balance", "other_noncurrent_assets", "other_noncurrent_assets", "'prior less other_investing'"),
    ("balance", "total_assets", "total_assets", "'sum of asset accounts'"),
    ("balance", "accounts_payable", "accounts_payable", "'dpo on cogs'"),
    ("balance", "other_current_liabilities", "other_current_liabilities", "'other_current_liabilities_pct_revenue'"),
    ("balance", "debt", "debt", "'opening + issuance - repayment'"),
    ("balance", "lease_liabilities", "lease_liabilities", "'held at the last actual balance'"),
    ("balance", "other_noncurrent_liabilities", "other_noncurrent_liabilities", "'prior plus other operating and financing'"),
    ("balance", "total_liabilities", "total_liabilities", "'sum of liability accounts'"),
    ("balance", "common_equity", "common_equity", "'prior + stock compensation - repurchases'"),
    ("balance", "retained_earnings", "retained_earnings", "'prior + net income - dividends'"),
    ("balance", "minority_interest", "minority_interest", "'held at the last actual balance'"),
    ("balance", "total_equity", "total_equity", "'sum of equity accounts'"),
    ("cashflow", "net_income", "net_income", "'from the income statement'"),
    ("cashflow", "depreciation_amortization", "depreciation", "'depreciation_pct_beginning_ppe on opening PP&E'"),
    ("cashflow", "stock_based_compensation", "stock_based_compensation", "'sbc_pct_revenue'"),
    ("cashflow", "change_in_nwc", "-change_in_nwc", "'negative of the change in working capital'"),
    ("cashflow", "other_operating", f"coalesce(other_operating, {ZERO})", "'other_operating'"),
    ("cashflow", "cash_flow_from_operations", "cfo", "'sum of operating items'"),
    ("cashflow", "capex", "-capex", "CASE WHEN capex_amount IS NOT NULL THEN 'capex_amount' ELSE concat('capex_pct_revenue = ', capex_pct_revenue) END"),
    ("cashflow", "acquisitions", f"-coalesce(acquisitions, {ZERO})", "'acquisitions'"),
    ("cashflow", "other_investing", f"coalesce(ppe_disposals, {ZERO}) + coalesce(other_investing, {ZERO})", "'disposals at book value + other_investing'"),
    ("cashflow", "cash_flow_from_investing", "cfi", "'sum of investing items'"),
    ("cashflow", "debt_issuance", f"coalesce(debt_issuance, {ZERO})", "'debt_issuance'"),
    ("cashflow", "debt_repayment", f"-coalesce(debt_repayment, {ZERO})", "'debt_repayment'"),
    ("cashflow", "share_repurchases", f"-coalesce(share_repurchases, {ZERO})", "'share_repurchases'"),
    ("cashflow", "dividends", "-dividends", "'payout ratio or amount'"),
    ("cashflow", "other_financing", f"coalesce(other_financing, {ZERO})", "'other_financing'"),
    ("cashflow", "cash_flow_from_financing", "cff", "'sum of financing items'"),
)
DERIVED_LINES = ("cash_flow_from_operations", "cash_flow_from_investing", "cash_flow_from_financing", "total_assets", "total_liabilities", "total_equity")


def to_long(fc: DataFrame) -> DataFrame:
    """Ledger rows of the forecast; every cell carries its basis."""
    rows = [
        (f"'{s}'", f"'{a}'", f"CAST({e} AS {MONEY})", f"'{'derived' if a in DERIVED_LINES else 'forecast'}'", b) for s, a, e, b in LINES
    ]
    return fc.selectExpr(*K, "year", stacked(rows, ("statement", "account", "value", "origin", "basis"))).where("value IS NOT NULL")


def as_wide(fc: DataFrame, *extra: str) -> DataFrame:
    """Forecast rows in the wide ledger shape, for the checks."""
    from .ledger import SLOTS, col_of

    have = {(s, a): e for s, a, e, _ in LINES}
    cols = [f"CAST({have.get((s, a), 'NULL')} AS {MONEY}) AS {col_of(s, a)}" for s, a in SLOTS]
    return fc.selectExpr(*K, "year", *cols, *extra)


def segment_revenue(segments: DataFrame, growth: DataFrame) -> DataFrame:
    """Revenue as the sum of separately grown segments.

    segments: company_id, segment, base_revenue. growth: company_id, scenario_id, segment, year, rate.
    """
    per = growth.groupBy(*K, "segment").agg(F.array_sort(F.collect_list(F.struct("year", "rate"))).alias("ys"))
    step = mul("s.rev", "1 + y.rate")
    fold = (
        f"aggregate(ys, named_struct('rev', CAST(base_revenue AS {MONEY}), 'out', CAST(array() AS ARRAY<STRUCT<year: INT, revenue: {MONEY}>>)),"
        f" (s, y) -> named_struct('rev', {step}, 'out', concat(s.out, array(named_struct('year', y.year, 'revenue', {step})))), s -> s.out)"
    )
    rows = per.join(segments, ["company_id", "segment"]).selectExpr(*K, "segment", f"inline({fold})")
    return rows.groupBy(*K, "year").agg(F.sum("revenue").cast(MONEY).alias("revenue"), F.count("*").alias("segments"))
