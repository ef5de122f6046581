"""Small dimension tables: chart of accounts, derivations, drivers, rules, registries.

All are far below any broadcast limit and do not grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

INCOME, BALANCE, CASHFLOW = "income", "balance", "cashflow"
STATEMENTS = (INCOME, BALANCE, CASHFLOW)

# Account, statements, expected sign, cash tag, flow tag, display name.
CHART = (
    ("revenue", (INCOME,), "positive", "not_applicable", "operating", "Revenue"),
    ("cogs", (INCOME,), "positive", "not_applicable", "operating", "Cost of goods sold"),
    ("gross_profit", (INCOME,), "either", "not_applicable", "operating", "Gross profit"),
    ("selling_general_administrative", (INCOME,), "positive", "not_applicable", "operating", "Selling, general and administrative"),
    ("research_development", (INCOME,), "positive", "not_applicable", "operating", "Research and development"),
    ("other_operating_expenses", (INCOME,), "either", "not_applicable", "operating", "Other operating expenses"),
    ("operating_expenses", (INCOME,), "positive", "not_applicable", "operating", "Operating expenses"),
    ("ebitda", (INCOME,), "either", "not_applicable", "operating", "EBITDA"),
    ("ebit", (INCOME,), "either", "not_applicable", "operating", "Operating income (EBIT)"),
    ("interest_income", (INCOME,), "positive", "not_applicable", "non_operating", "Interest income"),
    ("interest_expense", (INCOME,), "positive", "not_applicable", "non_operating", "Interest expense"),
    ("other_income_expense", (INCOME,), "either", "not_applicable", "non_operating", "Other income (expense), net"),
    ("pretax_income", (INCOME,), "either", "not_applicable", "not_applicable", "Income before income taxes"),
    ("taxes", (INCOME,), "positive", "not_applicable", "non_operating", "Income tax expense"),
    ("net_income", (INCOME, CASHFLOW), "either", "not_applicable", "not_applicable", "Net income"),
    ("net_income_to_parent", (INCOME,), "either", "not_applicable", "not_applicable", "Net income attributable to the parent"),
    ("net_income_to_minority", (INCOME,), "either", "not_applicable", "not_applicable", "Net income attributable to non-controlling interests"),
    ("cash", (BALANCE,), "positive", "not_applicable", "not_applicable", "Cash and cash equivalents"),
    ("accounts_receivable", (BALANCE,), "positive", "not_applicable", "operating", "Accounts receivable, net"),
    ("inventory", (BALANCE,), "positive", "not_applicable", "operating", "Inventories"),
    ("other_current_assets", (BALANCE,), "positive", "not_applicable", "operating", "Other current assets"),
    ("ppe_net", (BALANCE,), "positive", "not_applicable", "investing", "Property, plant and equipment, net"),
    ("goodwill", (BALANCE,), "positive", "not_applicable", "investing", "Goodwill"),
    ("intangibles", (BALANCE,), "positive", "not_applicable", "investing", "Intangible assets, net"),
    ("other_noncurrent_assets", (BALANCE,), "positive", "not_applicable", "investing", "Other non-current assets"),
    ("total_assets", (BALANCE,), "positive", "not_applicable", "not_applicable", "Total assets"),
    ("accounts_payable", (BALANCE,), "positive", "not_applicable", "operating", "Accounts payable"),
    ("other_current_liabilities", (BALANCE,), "positive", "not_applicable", "operating", "Other current liabilities"),
    ("debt", (BALANCE,), "positive", "not_applicable", "financing", "Debt"),
    ("lease_liabilities", (BALANCE,), "positive", "not_applicable", "financing", "Lease liabilities"),
    ("other_noncurrent_liabilities", (BALANCE,), "positive", "not_applicable", "not_applicable", "Other non-current liabilities"),
    ("total_liabilities", (BALANCE,), "positive", "not_applicable", "not_applicable", "Total liabilities"),
    ("common_equity", (BALANCE,), "either", "not_applicable", "financing", "Common equity"),
    ("retained_earnings", (BALANCE,), "either", "not_applicable", "financing", "Retained earnings"),
    ("minority_interest", (BALANCE,), "either", "not_applicable", "not_applicable", "Non-controlling interests"),
    ("total_equity", (BALANCE,), "either", "not_applicable", "not_applicable", "Total equity"),
    ("depreciation", (CASHFLOW,), "positive", "non_cash", "operating", "Depreciation"),
    ("amortization", (CASHFLOW,), "positive", "non_cash", "operating", "Amortization"),
    ("depreciation_amortization", (CASHFLOW,), "positive", "non_cash", "operating", "Depreciation and amortisation"),
    ("stock_based_compensation", (CASHFLOW,), "positive", "non_cash", "operating", "Stock-based compensation"),
    ("change_in_nwc", (CASHFLOW,), "either", "cash", "operating", "Change in net working capital"),
    ("other_operating", (CASHFLOW,), "either", "cash", "operating", "Other operating activities"),
    ("cash_flow_from_operations", (CASHFLOW,), "either", "cash", "operating", "Cash flow from operations"),
    ("capex", (CASHFLOW,), "negative", "cash", "investing", "Capital expenditure"),
    ("acquisitions", (CASHFLOW,), "negative", "cash", "investing", "Acquisitions, net of cash acquired"),
    ("disposals", (CASHFLOW,), "positive", "cash", "investing", "Disposals of businesses and assets"),
    ("other_investing", (CASHFLOW,), "either", "cash", "investing", "Other investing activities"),
    ("cash_flow_from_investing", (CASHFLOW,), "either", "cash", "investing", "Cash flow from investing"),
    ("debt_issuance", (CASHFLOW,), "positive", "cash", "financing", "Proceeds from borrowings"),
    ("debt_repayment", (CASHFLOW,), "negative", "cash", "financing", "Repayment of borrowings"),
    ("share_issuance", (CASHFLOW,), "positive", "cash", "financing", "Share issuance"),
    ("share_repurchases", (CASHFLOW,), "negative", "cash", "financing", "Share repurchases"),
    ("dividends", (CASHFLOW,), "negative", "cash", "financing", "Dividends paid"),
    ("other_financing", (CASHFLOW,), "either", "cash", "financing", "Other financing activities"),
    ("cash_flow_from_financing", (CASHFLOW,), "either", "cash", "financing", "Cash flow from financing"),
    ("fx_effect_on_cash", (CASHFLOW,), "either", "cash", "not_applicable", "Effect of exchange rates on cash"),
    ("net_change_in_cash", (CASHFLOW,), "either", "cash", "not_applicable", "Net change in cash"),
)

# Section membership.
ASSETS = ("cash", "accounts_receivable", "inventory", "other_current_assets", "ppe_net", "goodwill", "intangibles", "other_noncurrent_assets")
LIABILITIES = ("accounts_payable", "other_current_liabilities", "debt", "lease_liabilities", "other_noncurrent_liabilities")
EQUITY = ("common_equity", "retained_earnings", "minority_interest")
OPERATING_CURRENT_ASSETS = ("accounts_receivable", "inventory", "other_current_assets")
OPERATING_CURRENT_LIABILITIES = ("accounts_payable", "other_current_liabilities")
OPERATING_ITEMS = ("net_income", "depreciation_amortization", "stock_based_compensation", "change_in_nwc", "other_operating")
INVESTING_ITEMS = ("capex", "acquisitions", "disposals", "other_investing")
FINANCING_ITEMS = ("debt_issuance", "debt_repayment", "share_issuance", "share_repurchases", "dividends", "other_financing")
CASH_MOVEMENTS = ("cash_flow_from_operations", "cash_flow_from_investing", "cash_flow_from_financing", "fx_effect_on_cash")

# Subtotal -> (statement, added terms, subtracted terms).
DERIVATIONS = {
    "gross_profit": (INCOME, ("revenue",), ("cogs",)),
    "operating_expenses": (INCOME, ("selling_general_administrative", "research_development", "other_operating_expenses"), ()),
    "ebitda": (INCOME, ("ebit", "depreciation_amortization"), ()),
    "ebit": (INCOME, ("gross_profit",), ("operating_expenses",)),
    "pretax_income": (INCOME, ("ebit", "interest_income", "other_income_expense"), ("interest_expense",)),
    "net_income": (INCOME, ("pretax_income",), ("taxes",)),
    "total_assets": (BALANCE, ASSETS, ()),
    "total_liabilities": (BALANCE, LIABILITIES, ()),
    "total_equity": (BALANCE, EQUITY, ()),
    "depreciation_amortization": (CASHFLOW, ("depreciation", "amortization"), ()),
    "cash_flow_from_operations": (CASHFLOW, OPERATING_ITEMS, ()),
    "cash_flow_from_investing": (CASHFLOW, INVESTING_ITEMS, ()),
    "cash_flow_from_financing": (CASHFLOW, FINANCING_ITEMS, ()),
    "net_change_in_cash": (CASHFLOW, CASH_MOVEMENTS, ()),
}
ATTRIBUTION = {"net_income": ("net_income_to_parent", "net_income_to_minority")}

# Terms a subtotal may omit.
RESIDUAL_LINES = ("other_income_expense", "other_operating", "other_investing", "other_financing", "other_operating_expenses", "acquisitions", "disposals")
WHEN_APPLICABLE = (
    "goodwill", "intangibles", "lease_liabilities", "minority_interest", "interest_income", "amortization",
    "share_issuance", "fx_effect_on_cash", "selling_general_administrative", "research_development",
)
OPTIONAL_TERMS = frozenset(RESIDUAL_LINES + WHEN_APPLICABLE)

# Roll-forward schedules as (schedule, balance account, ((statement, account, multiplier, label), ...)).
ROLLFORWARDS = (
    ("ppe", "ppe_net", ((CASHFLOW, "capex", -1, "Capital expenditure"), (CASHFLOW, "depreciation_amortization", -1, "Depreciation and amortization"))),
    ("intangibles", "intangibles", ((CASHFLOW, "amortization", -1, "Amortization"),)),
    ("debt", "debt", ((CASHFLOW, "debt_issuance", 1, "Borrowing"), (CASHFLOW, "debt_repayment", 1, "Repayment"))),
    ("retained_earnings", "retained_earnings", ((INCOME, "net_income", 1, "Net income"), (CASHFLOW, "dividends", 1, "Dividends"))),
    ("common_equity", "common_equity", ((CASHFLOW, "share_repurchases", 1, "Share repurchases"), (CASHFLOW, "stock_based_compensation", 1, "Stock-based compensation"))),
)
SPLIT_DEPRECIATION = (CASHFLOW, "depreciation", -1, "Depreciation")

# Driver code, unit, alternative, required, name.
DRIVERS = (
    ("revenue_growth", "ratio", None, True, "Revenue growth"),
    ("cogs_pct_revenue", "ratio", "cogs_amount", True, "COGS as a share of revenue"),
    ("cogs_amount", "currency", "cogs_pct_revenue", True, "COGS, stated absolutely"),
    ("opex_pct_revenue", "ratio", "opex_amount", True, "Operating expenses as a share of revenue"),
    ("opex_amount", "currency", "opex_pct_revenue", True, "Operating expenses, stated absolutely"),
    ("depreciation_pct_beginning_ppe", "ratio", None, True, "Depreciation on opening PP&E"),
    ("capex_pct_revenue", "ratio", "capex_amount", True, "CapEx as a share of revenue"),
    ("capex_amount", "currency", "capex_pct_revenue", True, "CapEx, stated absolutely"),
    ("dso", "days", None, True, "Days sales outstanding"),
    ("inventory_days", "days", None, True, "Inventory days"),
    ("dpo", "days", None, True, "Days payable outstanding"),
    ("other_current_assets_pct_revenue", "ratio", None, True, "Other current assets on revenue"),
    ("other_current_liabilities_pct_revenue", "ratio", None, True, "Other current liabilities on revenue"),
    ("interest_rate_on_debt", "ratio", None, True, "Interest rate on beginning debt"),
    ("tax_rate", "ratio", None, True, "Effective tax rate"),
    ("ppe_disposals", "currency", None, False, "PP&E disposals"),
    ("debt_issuance", "currency", None, False, "New borrowing"),
    ("debt_repayment", "currency", None, False, "Debt repaid"),
    ("sbc_pct_revenue", "ratio", None, False, "Stock compensation on revenue"),
    ("share_repurchases", "currency", None, False, "Share repurchases"),
    ("dividends_amount", "currency", "dividend_payout_ratio", False, "Dividends, stated absolutely"),
    ("dividend_payout_ratio", "ratio", "dividends_amount", False, "Dividend payout ratio"),
    ("acquisitions", "currency", None, False, "Acquisitions"),
    ("other_income_expense", "currency", None, False, "Other income and expense"),
    ("other_operating", "currency", None, False, "Other operating cash flows"),
    ("other_investing", "currency", None, False, "Other investing cash flows"),
    ("other_financing", "currency", None, False, "Other financing cash flows"),
)

# Valuation inputs as (code, unit, required, group).
MARKET_INPUTS = (
    ("risk_free_rate", "ratio", True, "market"),
    ("beta", "ratio", True, "market"),
    ("equity_risk_premium", "ratio", True, "market"),
    ("pretax_cost_of_debt", "ratio", True, "market"),
    ("market_value_equity", "currency", True, "market"),
    ("market_value_debt", "currency", True, "market"),
    ("terminal_growth", "ratio", True, "market"),
    ("non_operating_investments", "currency", False, "bridge"),
    ("minority_interest", "currency", False, "bridge"),
    ("preferred_stock", "currency", False, "bridge"),
    ("pension_obligations", "currency", False, "bridge"),
    ("other_claims", "currency", False, "bridge"),
    ("diluted_shares", "shares", False, "bridge"),
)

# Reason code, blocking, meaning.
REASONS = (
    ("BLANK_CELL", True, "empty cell"),
    ("DASH_AMBIGUOUS", True, "a dash no legend defines"),
    ("NOT_APPLICABLE", True, "printed as not applicable"),
    ("NOT_NUMERIC", True, "not a number"),
    ("SEPARATOR_AMBIGUOUS", True, "separators read two ways"),
    ("OUT_OF_RANGE", True, "more digits than an amount can hold"),
    ("TOO_PRECISE", True, "more decimals than an amount can hold"),
    ("SCALE_UNCONFIRMED", True, "scale not confirmed"),
    ("CURRENCY_UNCONFIRMED", True, "currency not confirmed"),
    ("PERIOD_AMBIGUOUS", True, "period cannot be resolved"),
    ("SUBTOTAL_MISMATCH", True, "fails a subtotal reconciliation"),
    ("CROSS_STATEMENT_MISMATCH", True, "fails a cross-statement reconciliation"),
    ("RESTATEMENT_CONFLICT", True, "two columns disagree on one period"),
    ("SCOPE_AMBIGUOUS", True, "consolidation scope unknown"),
    ("SIGN_UNRESOLVED", True, "sign cannot be determined"),
    ("OCR_LOW_CONFIDENCE", True, "recognition confidence too low"),
    ("MULTI_CONCEPT_LINE", True, "one line, several concepts"),
    ("LOW_CONFIDENCE", True, "score below the review threshold"),
    ("DOUBLE_COUNTED", True, "would be counted twice"),
    ("OCR_DERIVED", False, "value came from recognition"),
    ("FOOTNOTE_MARKER_STRIPPED", False, "a footnote marker was removed"),
    ("HEADER_REPEATED", False, "table header repeats"),
    ("TABLE_SPLIT_ACROSS_PAGES", False, "table spans pages"),
    ("PAGE_ROTATED", False, "source page is rotated"),
    ("DISCONTINUED_OPERATIONS", False, "belongs to discontinued operations"),
    ("ADJUSTED_MEASURE", False, "adjusted figure"),
    ("RESTATED_VALUE", False, "comes from a restated column"),
    ("IMAGE_REGION_NOT_EXTRACTED", False, "image regions were not read"),
    ("WRITTEN_ZERO", False, "zero spelled in words"),
)
BLOCKING = tuple(c for c, b, _ in REASONS if b)
RECONCILIATION_CODES = ("SUBTOTAL_MISMATCH", "CROSS_STATEMENT_MISMATCH", "RESTATEMENT_CONFLICT", "DOUBLE_COUNTED")
REVIEW_THRESHOLD = "0.875"

# Intake refusal code, name, meaning.
REFUSALS = (
    ("ING-010-01", "not_a_pdf", "leading bytes are not a PDF signature"),
    ("ING-010-02", "truncated", "no end-of-file marker"),
    ("ING-010-03", "duplicate", "same hash already stored for this company"),
    ("ING-010-04", "encrypted", "cannot be read without a password"),
    ("ING-010-05", "active_content", "carries active content"),
    ("ING-010-06", "unreadable", "structure could not be parsed"),
    ("ING-010-08", "image_only_page", "image-only pages"),
    ("ING-010-07", "no_text_layer", "no extractable text"),
    ("ING-010-12", "overwrite_attempt", "a stored document may not be overwritten"),
    ("ING-020-08", "file_too_large", "over the byte limit"),
    ("ING-020-08", "too_many_pages", "over the page limit"),
    ("ING-020-11", "unsafe_filename", "file name cannot be made safe"),
)

# Check code, clause, severity, forced, comparison, stage.
CHECK_REGISTRY = (
    ("VAL-017-001", "17.1", "ERROR", False, "stored hash matches a rehash", "sources"),
    ("VAL-017-002", "17.2", "ERROR", False, "required metadata confirmed", "metadata"),
    ("VAL-017-003", "17.3", "ERROR", False, "every period unambiguous", "facts"),
    ("VAL-017-004", "17.4", "ERROR", False, "currency and scale confirmed", "metadata"),
    ("VAL-017-005", "17.5", "CRITICAL", False, "every critical fact verified", "facts"),
    ("VAL-017-006", "17.6", "ERROR", False, "every mapping approved", "mapping"),
    ("VAL-017-007", "17.7", "ERROR", False, "no fact counted twice", "mapping"),
    ("VAL-017-008", "17.8", "ERROR", False, "assets = liabilities + equity, historical", "historical"),
    ("VAL-017-009", "17.9", "ERROR", False, "cash roll-forward, historical", "historical"),
    ("VAL-017-010", "17.10", "ERROR", False, "reported subtotals equal components", "historical"),
    ("VAL-017-011", "17.11", "ERROR", False, "PP&E schedule ties", "schedules"),
    ("VAL-017-012", "17.12", "ERROR", False, "intangibles schedule ties", "schedules"),
    ("VAL-017-013", "17.13", "ERROR", False, "debt schedule ties", "schedules"),
    ("VAL-017-014", "17.14", "WARNING", False, "tax schedule reconciles", "schedules"),
    ("VAL-017-015", "17.15", "ERROR", False, "equity schedule reconciles", "schedules"),
    ("VAL-017-016", "17.16", "ERROR", False, "assets = liabilities + equity, forecast", "forecast"),
    ("VAL-017-017", "17.17", "ERROR", False, "cash roll-forward, forecast", "forecast"),
    ("VAL-017-018", "17.18", "CRITICAL", True, "no required assumption missing", "assumptions"),
    ("VAL-017-019", "17.19", "ERROR", False, "no rejected assumption used", "assumptions"),
    ("VAL-017-020", "17.20", "ERROR", False, "no hardcoded forecast cell", "forecast"),
    ("VAL-017-021", "17.21", "ERROR", False, "no cycle among formulas", "formulas"),
    ("VAL-017-022", "17.22", "ERROR", False, "FCFF equals the statement bridge", "valuation"),
    ("VAL-017-023", "17.23", "ERROR", False, "every WACC input sourced and dated", "valuation"),
    ("VAL-017-024", "17.24", "CRITICAL", True, "WACC above terminal growth", "valuation"),
    ("VAL-017-025", "17.25", "ERROR", False, "every equity-bridge line sourced", "valuation"),
    ("VAL-017-026", "17.26", "CRITICAL", True, "diluted shares nonzero and sourced", "valuation"),
    ("VAL-017-027", "17.27", "CRITICAL", True, "no NaN, infinity or null released", "release"),
    ("VAL-017-028", "17.28", "ERROR", True, "independent benchmark within tolerance", "release"),
    ("VAL-017-029", "17.29", "ERROR", False, "displayed values tie to stored ones", "release"),
    ("VAL-017-030", "17.30", "ERROR", False, "every output has lineage", "release"),
)
NOT_ACTIONABLE = ("17.21", "17.28")

# Assumption source types, engine basis, evidence each must carry, statuses.
ENGINE_BASIS = {
    "Company Guidance": "company_guidance",
    "Company Filing": "company_guidance",
    "External Market Data": "external_research",
    "Historical Driver": "external_research",
    "Analyst Assumption": "model_assumption",
    "Scenario Override": "model_assumption",
}
STATUSES = ("Draft", "Needs Source", "Reviewed", "Approved", "Rejected")
BLOCKING_STATUSES = ("Draft", "Needs Source", "Rejected")

# Allowed state changes.
ASSUMPTION_EDGES = (
    ("Draft", "Needs Source"), ("Draft", "Reviewed"), ("Draft", "Rejected"),
    ("Needs Source", "Draft"), ("Needs Source", "Reviewed"), ("Needs Source", "Rejected"),
    ("Reviewed", "Approved"), ("Reviewed", "Rejected"), ("Reviewed", "Draft"),
    ("Approved", "Draft"), ("Approved", "Rejected"),
    ("Rejected", "Draft"),
)
JOB_EDGES = (
    ("received", "validating"), ("received", "refused"), ("received", "failed"),
    ("validating", "stored"), ("validating", "refused"), ("validating", "failed"),
    ("stored", "classifying"), ("stored", "refused"), ("stored", "failed"),
    ("classifying", "extracting"), ("classifying", "refused"), ("classifying", "failed"),
    ("extracting", "extracted"), ("extracting", "refused"), ("extracting", "failed"),
)
JOB_STATES = ("received", "validating", "stored", "classifying", "extracting", "extracted", "refused", "failed")
FACT_STATES = ("unreviewed", "accepted", "corrected", "rejected")
DOCUMENT_STATES = ("unconfirmed", "confirmed")

# Model status in order of progress.
MODEL_STATUSES = ("Draft", "Extracting", "Needs Review", "Validated", "Forecast Ready", "Valuation Ready", "Archived")

# Allowed events and trailing window in seconds, per class.
RATE_LIMITS = {"authentication": (5, 300), "upload": (20, 3600), "extraction": (20, 3600), "export": (60, 3600)}

# Sections a source map must locate.
REQUIRED_SECTIONS = (
    "income_statement", "balance_sheet", "cash_flow_statement", "statement_of_shareholders_equity", "revenue_notes",
    "ppe_depreciation_notes", "debt_notes", "tax_notes", "lease_notes", "stock_compensation_notes",
    "share_count_eps_notes", "mdna",
)

# Words that claim a likelihood, and percentile shorthand.
PROBABILITY_WORDS = (
    "likely", "unlikely", "probable", "probability", "improbable", "expected", "certain", "uncertain",
    "guaranteed", "odds", "chance", "median", "percentile", "confidence",
)
PERCENTILE_PATTERN = r"(?i)\bp\s?\d{1,3}\b"


def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small literal table planned as VALUES: no job to build it, and its size is known."""
    cols = [c.strip().split(" ") for c in schema.split(",")]

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    picks = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(cols))
    return spark.sql(f"SELECT {picks} FROM VALUES {body} AS t({', '.join(f'c{i}' for i in range(len(cols)))})")


def account_order() -> dict[str, int]:
    return {row[0]: i for i, row in enumerate(CHART)}


def accounts_of(statement: str) -> list[str]:
    return [row[0] for row in CHART if statement in row[1]]


def slots() -> list[tuple[str, str]]:
    """(statement, account) pairs; net income has two."""
    return [(s, row[0]) for row in CHART for s in row[1]]


def ancestors() -> dict[str, frozenset[str]]:
    """Every subtotal a line feeds, transitively, from the fixed rules above."""
    parents: dict[str, set[str]] = {}
    for target, (_, plus, minus) in DERIVATIONS.items():
        for term in plus + minus:
            parents.setdefault(term, set()).add(target)

    def up(code: str, seen: frozenset[str]) -> frozenset[str]:
        fresh = frozenset(parents.get(code, ())) - seen
        return reduce(lambda acc, p: up(p, acc), fresh, seen | fresh)

    return {row[0]: up(row[0], frozenset()) for row in CHART}


def levels() -> list[list[str]]:
    """Derivation targets grouped by dependency depth; refuses a cycle."""
    depth: dict[str, int] = {}

    def of(target: str, path: tuple[str, ...]) -> int:
        if target in path:
            raise ValueError(f"derivations form a cycle through {target}")
        if target not in depth:
            st, plus, minus = DERIVATIONS[target]
            below = [t for t in plus + minus if t in DERIVATIONS]
            depth[target] = 1 + max((of(t, path + (target,)) for t in below), default=0)
        return depth[target]

    for t in DERIVATIONS:
        of(t, ())
    out: list[list[str]] = [[] for _ in range(max(depth.values()))]
    for t in DERIVATIONS:
        out[depth[t] - 1].append(t)
    return out


def required_choices() -> list[tuple[str, ...]]:
    """Groups of drivers of which exactly one must be supplied."""
    seen = {tuple(sorted({c, alt} - {None})) for c, _, alt, req, _ in DRIVERS if req}
    return sorted(seen)


def chart_df(spark: SparkSession) -> DataFrame:
    rows = [(a, s, sg, ct, ft, n, i) for i, (a, ss, sg, ct, ft, n) in enumerate(CHART) for s in ss]
    return local_table(
        spark,
        rows,
        "account string, statement string, expected_sign string, cash_tag string, flow_tag string, display_name string, display_order int",
    )


def derivation_df(spark: SparkSession) -> DataFrame:
    rows = [
        (target, st, term, sign, term in OPTIONAL_TERMS)
        for target, (st, plus, minus) in DERIVATIONS.items()
        for terms, sign in ((plus, 1), (minus, -1))
        for term in terms
    ]
    return local_table(spark, rows, "target string, statement string, term string, sign int, optional boolean")


def closure_df(spark: SparkSession) -> DataFrame:
    rows = [(a, up) for a, ups in ancestors().items() for up in sorted(ups)]
    return local_table(spark, rows, "account string, ancestor string")


def reason_df(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(REASONS), "code string, blocking boolean, summary string")


def driver_df(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        [(c, u, a, r, n, i) for i, (c, u, a, r, n) in enumerate(DRIVERS)],
        "code string, unit string, alternative string, required boolean, name string, driver_order int",
    )


def required_choice_df(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        [("|".join(g), c) for g in required_choices() for c in g], "choice string, code string"
    )


def market_input_df(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(MARKET_INPUTS), "code string, unit string, required boolean, grp string")


def registry_df(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        list(CHECK_REGISTRY),
        "code string, clause string, severity string, forced boolean, compares string, stage string",
    )


def refusal_df(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(REFUSALS), "code string, name string, summary string")
