"""Statement tables derived by Spark from transaction tables.

A company is a supplier, a period is a ship year. Every line is a sum over line items, so the
ledger grows with them. The texts below are plain SQL expressions and run in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..money import MONEY, RATE

# Line-item sums per company and year.
COMPANY_YEAR_SUMS = (
    ("rev", "SUM(px * (1 - disc))"),
    ("disc_amt", "SUM(px * disc)"),
    ("tax_amt", "SUM(px * tx)"),
    ("px_r", "SUM(CASE WHEN rf = 'R' THEN px ELSE 0 END)"),
    ("px_a", "SUM(CASE WHEN rf = 'A' THEN px ELSE 0 END)"),
    ("qf", "SUM(CASE WHEN ls = 'F' THEN q * rp ELSE 0 END)"),
    ("qo", "SUM(CASE WHEN ls = 'O' THEN q * rp ELSE 0 END)"),
)

_NI = "(rev - qf - disc_amt - 0.02 * px_r - CASE WHEN company_id % 7 = 0 THEN 0 ELSE tax_amt END)"
_ASSETS = (
    "(0.10 * rev + px_r + qo + 0.02 * rev + 0.6 * rev + CASE WHEN company_id % 5 = 0 THEN 0.03 * rev ELSE 0 END"
    " + CASE WHEN company_id % 9 = 0 THEN 0.02 * rev ELSE 0 END + 0.05 * rev)"
)
_LIABS = "(CASE WHEN company_id % 11 = 0 THEN 0 ELSE 0.4 * qf END + 0.04 * rev + 0.3 * rev + 0.05 * rev)"
_RE = f"({_ASSETS} - {_LIABS} - 0.2 * rev + CASE WHEN company_id % 3 = 0 THEN tax_amt ELSE 0 END)"

# (statement, account, amount); NULL means the filing does not report the line.
LEDGER_LINES = (
    ("income", "revenue", "rev"),
    ("income", "cogs", "qf"),
    ("income", "gross_profit", "CASE WHEN company_id % 2 = 0 THEN rev - qf + CASE WHEN company_id % 8 = 0 THEN 1 ELSE 0 END END"),
    ("income", "operating_expenses", "disc_amt"),
    ("income", "interest_expense", "0.02 * px_r"),
    ("income", "taxes", "CASE WHEN company_id % 7 <> 0 THEN tax_amt END"),
    ("balance", "cash", "0.10 * rev"),
    ("balance", "accounts_receivable", "px_r"),
    ("balance", "inventory", "qo"),
    ("balance", "other_current_assets", "0.02 * rev"),
    ("balance", "ppe_net", "0.6 * rev"),
    ("balance", "goodwill", "CASE WHEN company_id % 5 = 0 THEN 0.03 * rev END"),
    ("balance", "intangibles", "CASE WHEN company_id % 9 = 0 THEN 0.02 * rev END"),
    ("balance", "other_noncurrent_assets", "0.05 * rev"),
    ("balance", "total_assets", f"CASE WHEN company_id % 2 = 0 THEN {_ASSETS} END"),
    ("balance", "accounts_payable", "CASE WHEN company_id % 11 <> 0 THEN 0.4 * qf END"),
    ("balance", "other_current_liabilities", "0.04 * rev"),
    ("balance", "debt", "0.3 * rev"),
    ("balance", "other_noncurrent_liabilities", "0.05 * rev"),
    ("balance", "common_equity", "0.2 * rev"),
    ("balance", "retained_earnings", _RE),
    ("cashflow", "net_income", f"CASE WHEN company_id % 4 <> 3 THEN {_NI} + CASE WHEN company_id % 10 = 9 THEN 2 ELSE 0 END END"),
    ("cashflow", "depreciation", "CASE WHEN company_id % 9 = 0 THEN 0.03 * rev END"),
    ("cashflow", "amortization", "CASE WHEN company_id % 9 = 0 THEN 0.01 * rev END"),
    ("cashflow", "depreciation_amortization", "CASE WHEN company_id % 9 <> 0 THEN 0.04 * rev END"),
    ("cashflow", "stock_based_compensation", "0.01 * rev"),
    ("cashflow", "change_in_nwc", "CASE WHEN company_id % 2 = 0 THEN -0.01 * rev END"),
    ("cashflow", "cash_flow_from_operations", f"CASE WHEN company_id % 4 = 0 THEN {_NI} + 0.04 * rev END"),
    ("cashflow", "capex", "-0.06 * rev"),
    ("cashflow", "cash_flow_from_investing", "CASE WHEN company_id % 2 = 0 THEN -0.06 * rev + CASE WHEN company_id % 10 = 0 THEN 1 ELSE 0 END END"),
    ("cashflow", "debt_issuance", "CASE WHEN company_id % 3 = 1 THEN 0.02 * px_a END"),
    ("cashflow", "debt_repayment", "-0.01 * rev"),
    ("cashflow", "share_repurchases", "CASE WHEN company_id % 4 <> 1 THEN -0.002 * rev END"),
    ("cashflow", "dividends", "-0.005 * rev"),
)

# A ledger whose statements tie over all years: balances are opening balances plus the flows since. Layers of (name, amount),
# each over the names of those before it. One company in eleven per fault carries it, the others carry none.
_SINCE = "OVER (PARTITION BY company_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_IN_ORDER = "OVER (PARTITION BY company_id ORDER BY year)"
_FAULT = lambda number, year, amount: f"CASE WHEN company_id % 11 = {number} AND year = {year} THEN {amount} ELSE 0 END"
_RUN = lambda flow: f"SUM(CASE WHEN n > 1 THEN {flow} ELSE 0 END) {_SINCE}"
TIED_LAYERS = (
    (("revenue", "rev"), ("cogs", "qf"), ("operating_expenses", "disc_amt"), ("interest", "0.02 * px_r"), ("taxes", "tax_amt"), ("depreciation", "0.03 * rev"),
     ("amortization", "0.01 * rev"), ("sbc", "0.01 * rev"), ("capex", "0.06 * rev"), ("issued", "0.02 * px_a"), ("repaid", "0.01 * rev"), ("repurchased", "0.002 * rev"),
     ("dividends", "0.005 * rev"), ("receivable", "px_r"), ("inventory", "qo"), ("other_ca", "0.02 * rev"), ("payable", "0.4 * qf"), ("other_cl", "0.04 * rev")),
    (("ni", "revenue - cogs - operating_expenses - interest - taxes"), ("nwc", "receivable + inventory + other_ca - payable - other_cl"), ("rev0", f"FIRST_VALUE(revenue) {_IN_ORDER}"), ("n", f"ROW_NUMBER() {_IN_ORDER}")),
    (("dnwc", f"nwc - LAG(nwc) {_IN_ORDER}"), ("nwc0", f"FIRST_VALUE(nwc) {_IN_ORDER}")),
    (("cfo", "ni + depreciation + amortization + sbc - dnwc"), ("cff", "issued - repaid - repurchased - dividends")),
    (("cash", f"0.1 * rev0 + {_RUN('cfo - capex + cff')} + {_FAULT(3, 2001, 500)}"), ("ppe", f"0.6 * rev0 + {_RUN('capex - depreciation')} + {_FAULT(4, 1998, 7)}"),
     ("intangible", f"0.2 * rev0 - {_RUN('amortization')} + {_FAULT(6, 1999, 3)}"), ("debt", f"0.3 * rev0 + {_RUN('issued - repaid')} + {_FAULT(5, 1999, 9)}"),
     ("stock", f"0.2 * rev0 + {_RUN('sbc - repurchased')}"), ("earned", f"nwc0 + 0.4 * rev0 + {_RUN('ni - dividends')} + {_FAULT(2, 2000, 1000)}"),
     ("other_na", f"0.1 * rev0 - {_FAULT(4, 1998, 7)} - {_FAULT(6, 1999, 3)}"), ("other_nl", f"0.1 * rev0 + {_FAULT(3, 2001, 500)} - {_FAULT(5, 1999, 9)}")),
)
TIED_LINES = (
    ("income", "revenue", "revenue"), ("income", "cogs", "cogs"), ("income", "gross_profit", "revenue - cogs + CASE WHEN company_id % 11 = 7 THEN 5 ELSE 0 END"), ("income", "operating_expenses", "operating_expenses"),
    ("income", "interest_expense", "interest"), ("income", "taxes", "taxes"),
    ("balance", "cash", "cash"), ("balance", "accounts_receivable", "receivable"), ("balance", "inventory", "inventory"), ("balance", "other_current_assets", "other_ca"), ("balance", "ppe_net", "ppe"),
    ("balance", "intangibles", "intangible"), ("balance", "other_noncurrent_assets", "other_na"), ("balance", "accounts_payable", "payable"), ("balance", "other_current_liabilities", "other_cl"),
    ("balance", "debt", "debt"), ("balance", "other_noncurrent_liabilities", "other_nl"), ("balance", "common_equity", "stock"), ("balance", "retained_earnings", "earned"),
    ("cashflow", "net_income", "ni"), ("cashflow", "depreciation", "depreciation"), ("cashflow", "amortization", "amortization"), ("cashflow", "stock_based_compensation", "sbc"),
    ("cashflow", "change_in_nwc", "-dnwc"), ("cashflow", "cash_flow_from_operations", "cfo"), ("cashflow", "capex", "-capex"), ("cashflow", "cash_flow_from_investing", "-capex"),
    ("cashflow", "debt_issuance", "issued"), ("cashflow", "debt_repayment", "-repaid"), ("cashflow", "share_repurchases", "-repurchased"), ("cashflow", "dividends", "-dividends"),
)

FIRST_YEAR, LAST_YEAR = 1995, 2001
FORECAST_YEARS = (2002, 2003, 2004, 2005, 2006)

# (scenario, parent, name)
SCENARIOS = (
    ("base", None, "Base case"),
    ("upside", "base", "Upside case"),
    ("downside", "base", "Downside case"),
    ("stretch", "upside", "Stretch, p90 outcome"),
)

# (scenario, code, period, unit, value over the last actual year, status, source type, keep this row when)
ASSUMPTIONS = (
    ("base", "revenue_growth", 2002, "ratio", "0.08 + 0.001 * (company_id % 5)", "Approved", "Company Guidance", "TRUE"),
    ("base", "revenue_growth", 2003, "ratio", "0.07", "Approved", "Company Guidance", "TRUE"),
    ("base", "revenue_growth", None, "ratio", "0.05", "Approved", "Analyst Assumption", "TRUE"),
    ("base", "cogs_pct_revenue", None, "ratio", "cogs / revenue", "Approved", "Historical Driver", "company_id % 4 <> 0"),
    ("base", "cogs_amount", None, "currency", "cogs", "Approved", "Analyst Assumption", "company_id % 4 = 0"),
    ("base", "opex_pct_revenue", None, "ratio", "operating_expenses / revenue", "Approved", "Historical Driver", "TRUE"),
    ("base", "depreciation_pct_beginning_ppe", None, "ratio", "0.10", "Approved", "Historical Driver", "TRUE"),
    ("base", "capex_pct_revenue", None, "ratio", "0.07", "Approved", "Analyst Assumption", "TRUE"),
    ("base", "dso", None, "days", "CAST(accounts_receivable AS DECIMAL(18,6)) * 365 / CAST(revenue AS DECIMAL(18,6))", "Approved", "Historical Driver", "TRUE"),
    ("base", "inventory_days", None, "days", "CAST(60 + company_id % 10 AS DECIMAL(12,8))", "Approved", "Historical Driver", "TRUE"),
    ("base", "dpo", None, "days", "CAST(50 AS DECIMAL(12,8))", "Approved", "Historical Driver", "TRUE"),
    ("base", "other_current_assets_pct_revenue", None, "ratio", "0.02", "Approved", "Analyst Assumption", "TRUE"),
    ("base", "other_current_liabilities_pct_revenue", None, "ratio", "0.04", "Approved", "Analyst Assumption", "TRUE"),
    ("base", "interest_rate_on_debt", None, "ratio", "0.05", "Approved", "Historical Driver", "TRUE"),
    ("base", "tax_rate", None, "ratio", "0.25", "Approved", "Historical Driver", "company_id % 13 <> 0"),
    ("base", "debt_repayment", None, "currency", "0.05 * debt", "Approved", "Company Filing", "TRUE"),
    ("base", "sbc_pct_revenue", None, "ratio", "0.01", "Approved", "Analyst Assumption", "TRUE"),
    ("base", "share_repurchases", None, "currency", "1000", "Approved", "Analyst Assumption", "TRUE"),
    ("base", "dividend_payout_ratio", None, "ratio", "0.3", "Approved", "Analyst Assumption", "TRUE"),
    ("base", "risk_free_rate", None, "ratio", "0.042", "Approved", "External Market Data", "TRUE"),
    ("base", "beta", None, "ratio", "1.10 + 0.01 * (company_id % 20)", "Approved", "External Market Data", "TRUE"),
    ("base", "equity_risk_premium", None, "ratio", "0.055", "Approved", "External Market Data", "TRUE"),
    ("base", "pretax_cost_of_debt", None, "ratio", "0.055", "Approved", "External Market Data", "TRUE"),
    ("base", "market_value_equity", None, "currency", "3 * revenue", "Approved", "External Market Data", "TRUE"),
    ("base", "market_value_debt", None, "currency", "debt", "Approved", "External Market Data", "TRUE"),
    ("base", "terminal_growth", None, "ratio", "0.025", "Approved", "Analyst Assumption", "company_id % 19 <> 0"),
    ("base", "diluted_shares", None, "shares", "CAST(100 + company_id % 50 AS DECIMAL(12,8)) * 1000", "Approved", "Company Filing", "company_id % 6 <> 5"),
    ("base", "minority_interest", None, "currency", "0.01 * revenue", "Approved", "Company Filing", "company_id % 5 = 0"),
    ("upside", "revenue_growth", None, "ratio", "0.12", "Approved", "Scenario Override", "TRUE"),
    ("upside", "revenue_growth", 2006, "ratio", "0.10", "Approved", "Scenario Override", "TRUE"),
    ("upside", "capex_pct_revenue", None, "ratio", "0.07", "Approved", "Scenario Override", "TRUE"),
    ("downside", "revenue_growth", 2004, "ratio", "-0.02", "Approved", "Scenario Override", "TRUE"),
    ("downside", "opex_pct_revenue", None, "ratio", "operating_expenses / revenue + 0.03", "Approved", "Scenario Override", "TRUE"),
    ("downside", "dso", None, "days", "CAST(accounts_receivable AS DECIMAL(18,6)) * 365 / CAST(revenue AS DECIMAL(18,6)) + 5", "Draft", "Scenario Override", "company_id % 17 = 3"),
    ("stretch", "revenue_growth", 2002, "ratio", "0.15", "Approved", "Scenario Override", "TRUE"),
    ("stretch", "terminal_growth", None, "ratio", "0.03", "Approved", "Scenario Override", "TRUE"),
)

# What the tied companies' scenarios add: every equity-bridge line stated (one in seven leaves them open), and one override that was rejected.
TIED_ASSUMPTIONS = ASSUMPTIONS + tuple(
    ("base", c, None, "currency", "CAST(0 AS DECIMAL(12,8)) * revenue", "Approved", "Company Filing", "company_id % 7 <> 3" + (" AND company_id % 5 <> 0" if c == "minority_interest" else ""))
    for c in ("non_operating_investments", "minority_interest", "preferred_stock", "pension_obligations", "other_claims")
) + (("upside", "sbc_pct_revenue", None, "ratio", "0.02", "Rejected", "Scenario Override", "company_id % 10 = 8"),)
#: When an input was observed; one in thirteen companies does not say it for beta.
OBSERVED = "CASE WHEN NOT (code = 'beta' AND company_id % 13 = 6) THEN '2001-12-31' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def company_year(spark: SparkSession, sf_dir: str, keep: str = "TRUE") -> DataFrame:
    """One row per company and ship year for which `keep` holds. The part join is left to the optimizer: broadcast
    while `part` is under the threshold, otherwise a sort-merge join whose hot keys AQE splits."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("company_id"),
        F.col("l_partkey").alias("p_partkey"),
        F.year("l_shipdate").alias("year"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("px"),
        F.col("l_discount").cast("decimal(4,2)").alias("disc"),
        F.col("l_tax").cast("decimal(4,2)").alias("tx"),
        F.col("l_quantity").cast("decimal(8,2)").alias("q"),
        F.col("l_returnflag").alias("rf"),
        F.col("l_linestatus").alias("ls"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("rp"))
    return (
        li.join(part, "p_partkey")
        .groupBy("company_id", "year")
        .agg(*[F.expr(e).cast("decimal(25,4)").alias(n) for n, e in COMPANY_YEAR_SUMS])
        .where(keep)
    )


def ledger(spark: SparkSession, sf_dir: str, keep: str = "TRUE") -> DataFrame:
    """Reported lines: company_id, statement, account, year, value. Absence is no row."""
    cells = ", ".join(f"'{st}', '{a}', CAST({e} AS {MONEY})" for st, a, e in LEDGER_LINES)
    return (
        company_year(spark, sf_dir, keep)
        .selectExpr("company_id", "year", f"stack({len(LEDGER_LINES)}, {cells}) AS (statement, account, value)")
        .where("value IS NOT NULL")
        .selectExpr("company_id", "statement", "account", "year", "value", "'reported' AS origin")
    )


def tied_ledger(spark: SparkSession, sf_dir: str, years: DataFrame | None = None) -> DataFrame:
    """The same columns as `ledger`, of statements that tie over all years but for the faults of TIED_LAYERS. years: company_year, where it is staged."""
    rows = company_year(spark, sf_dir) if years is None else years
    for layer in TIED_LAYERS:
        rows = rows.selectExpr("*", *[f"{e} AS {n}" if n == "n" else f"CAST({e} AS {MONEY}) AS {n}" for n, e in layer])
    cells = ", ".join(f"'{st}', '{a}', CAST({e} AS {MONEY})" for st, a, e in TIED_LINES)
    long = rows.selectExpr("company_id", "year", f"stack({len(TIED_LINES)}, {cells}) AS (statement, account, value)")
    return long.where("value IS NOT NULL").selectExpr("company_id", "statement", "account", "year", "value", "'reported' AS origin")


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ", ".join(f"'{s}', CAST({'NULL' if p is None else repr(p)} AS STRING), '{n}'" for s, p, n in SCENARIOS)
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS company_id", f"stack({len(SCENARIOS)}, {cells}) AS (scenario_id, parent_id, name)"
    )


def assumptions(spark: SparkSession, sf_dir: str, keep: str = "TRUE", rows: tuple = ASSUMPTIONS, years: DataFrame | None = None) -> DataFrame:
    """Drivers and market inputs per company and scenario, measured on the company's own last year. years: company_year, where it is staged."""
    names = {a: e for s, a, e in LEDGER_LINES if s != "cashflow"}
    measured = ("revenue", "cogs", "operating_expenses", "accounts_receivable", "debt")
    last = (
        (company_year(spark, sf_dir, keep) if years is None else years.where(keep))
        .select("company_id", "year", *[F.expr(names[a]).cast(MONEY).alias(a) for a in measured])
        .groupBy("company_id")
        .agg(F.max_by(F.struct(*measured), "year").alias("last"))
        .select("company_id", "last.*")
    )
    cells = []
    for i, (s, c, p, u, v, st, src, k) in enumerate(rows):
        amount = f"CAST(CAST({v} AS {RATE}) AS {MONEY})" if u in ("ratio", "days") else f"CAST({v} AS {MONEY})"
        cells.append(f"'{s}', '{c}', CAST({'NULL' if p is None else p} AS INT), '{u}', {amount}, '{st}', '{src}', {i}, {k}")
    names = "scenario_id, code, period, unit, value, status, source_type, seq, keep"
    return last.selectExpr("company_id", f"stack({len(rows)}, {', '.join(cells)}) AS ({names})").where("keep").drop("keep")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as an audit log."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("at"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("actor"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("entity-"), F.get_json_object("props", "$.k")).alias("entity_id"),
        F.when(F.col("value") > 50, "fact").otherwise("document").alias("entity_type"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
    )
