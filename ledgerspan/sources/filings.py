"""Page tables, documents, decisions and mappings derived by Spark from the ledger of derived.py.

Every ledger value becomes one printed cell of its company's filing, in that company's number
format, so the volume follows the ledger and the round trip can be checked.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels as LB
from ..money import MONEY
from ..operators import facts as FA
from ..operators import mapping as MP
from ..operators import review as RV
from ..session import cut_lineage
from . import derived as D

PAGES = {"income": 1, "balance": 2, "cashflow": 3}
CAPTIONS = {"income": "Statements of Income", "balance": "Balance Sheets", "cashflow": "Statements of Cash Flows"}

# (account, printed label) in the order of the ledger lines.
LABELS = (
    ("revenue", "Net sales"), ("cogs", "Cost of goods sold"), ("gross_profit", "Gross profit"), ("operating_expenses", "Total operating expenses"),
    ("interest_expense", "Interest expense"), ("taxes", "Income tax expense"), ("cash", "Cash and cash equivalents"),
    ("accounts_receivable", "Accounts receivable, net"), ("inventory", "Inventories"), ("other_current_assets", "Other current assets"),
    ("ppe_net", "Property, plant and equipment, net"), ("goodwill", "Goodwill"), ("intangibles", "Intangible assets, net"),
    ("other_noncurrent_assets", "Other non-current assets"), ("total_assets", "Total assets"), ("accounts_payable", "Accounts payable"),
    ("other_current_liabilities", "Other current liabilities"), ("debt", "Long-term debt"), ("other_noncurrent_liabilities", "Other non-current liabilities"),
    ("common_equity", "Common stock"), ("retained_earnings", "Retained earnings"), ("net_income", "Net income"), ("depreciation", "Depreciation"),
    ("amortization", "Amortization of intangible assets"), ("depreciation_amortization", "Depreciation and amortization"),
    ("stock_based_compensation", "Stock-based compensation"), ("change_in_nwc", "Changes in working capital"),
    ("cash_flow_from_operations", "Net cash provided by operating activities"), ("capex", "Purchases of property, plant and equipment"),
    ("cash_flow_from_investing", "Net cash used in investing activities"), ("debt_issuance", "Proceeds from long-term debt"),
    ("debt_repayment", "Repayments of long-term debt"), ("share_repurchases", "Repurchases of common stock"), ("dividends", "Dividends paid"),
)
ROWS = {a: i + 1 for i, (_, a, _) in enumerate(D.LEDGER_LINES)}
DASH_WHEN = "company_id % 13 = 5 AND year = 1996"
FOOTNOTE_WHEN = "company_id % 4 = 1 AND year = 1999"
FLIPPED_WHEN = "account = 'cogs' AND company_id % 16 = 9"
LOCALE = "CASE WHEN company_id % 20 = 19 THEN 'unknown' WHEN company_id % 3 = 1 THEN 'comma_decimal' ELSE 'dot_decimal' END"
SCALE_OK, CURRENCY_OK = "company_id % 8 <> 7", "company_id % 9 <> 8"


def _case(column: str, pairs) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + v + "'"

    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in pairs) + " END"


def raw_cells(spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None) -> DataFrame:
    """document_id, page, table_id, row, col, text, caption of the derived ledger, or of another one, which is read six times: hand in a stage table.
    Where that is clustered on the company, no cell moves."""
    led = (cut_lineage(D.ledger(spark, sf_dir), "company_id") if ledger is None else ledger).selectExpr(
        "company_id", "account", "year", "value", f"{_case('statement', PAGES.items())} AS page", f"{_case('account', ROWS.items())} AS row",
        f"concat(CASE WHEN company_id % 10 IN (3, 7) THEN '' ELSE 'Consolidated ' END, {_case('statement', CAPTIONS.items())}, CASE WHEN company_id % 10 = 7 THEN ' by segment' ELSE '' END) AS caption",
    )
    digits = "format_number(abs(value), 2)"
    digits = f"CASE WHEN company_id % 3 = 1 THEN translate({digits}, ',.', '.,') ELSE {digits} END"
    text = (
        f"CASE WHEN {DASH_WHEN} THEN '—' ELSE concat(CASE WHEN account = 'revenue' AND company_id % 3 <> 1 THEN '$' ELSE '' END,"
        f" CASE WHEN (value < 0) <> ({FLIPPED_WHEN}) THEN concat('(', {digits}, ')') ELSE {digits} END, CASE WHEN {FOOTNOTE_WHEN} THEN '(2)' ELSE '' END) END"
    )
    key = ["company_id AS document_id", "page", "concat(company_id, '-', page) AS table_id"]
    values = led.selectExpr(*key, "row", f"year - {D.FIRST_YEAR - 1} AS col", f"{text} AS text", "caption")
    # texts are made of the few rows that are left, which are told apart once more, because two accounts may read alike
    labels = led.select("company_id", "page", "row", "account", "caption").distinct().selectExpr(*key, "row", "0 AS col", f"{_case('account', LABELS)} AS text", "caption").distinct()
    tables = led.select("company_id", "page", "year", "caption").distinct()
    n = D.LAST_YEAR - D.FIRST_YEAR + 1
    head = tables.selectExpr(*key, "explode(CASE WHEN company_id % 10 = 4 AND page = 2 THEN array(0, 99) ELSE array(0) END) AS row", f"year - {D.FIRST_YEAR - 1} AS col", "CAST(year AS STRING) AS text", "caption")
    once = tables.select("company_id", "page", "caption").distinct()
    corner = once.selectExpr(*key, "explode(CASE WHEN company_id % 10 = 4 AND page = 2 THEN array(0, 99) ELSE array(0) END) AS row", "0 AS col", "'' AS text", "caption")
    heading = once.selectExpr(*key, "90 AS row", f"explode(sequence(0, {n})) AS col", "caption").selectExpr("document_id", "page", "table_id", "row", "col", "CASE WHEN col = 0 THEN 'Memorandum' ELSE '' END AS text", "caption")
    tail = once.where("page = 3 AND company_id % 6 = 1").selectExpr("company_id AS document_id", "4 AS page", "concat(company_id, '-4') AS table_id", "1 AS row", f"explode(sequence(0, {n})) AS col", "caption").selectExpr(
        "document_id", "page", "table_id", "row", "col", "CASE WHEN col = 0 THEN 'Other activities' ELSE '1.00' END AS text", "caption"
    )
    out = values
    for part in (labels, head, corner, heading, tail):
        out = out.unionByName(part)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS company_id", "s_name AS company_name", "s_nationkey").selectExpr(
        "company_id AS document_id", "company_name", f"{LOCALE} AS locale", f"{SCALE_OK} AS scale_confirmed", f"{CURRENCY_OK} AS currency_confirmed",
        f"{SCALE_OK} AND {CURRENCY_OK} AS metadata_confirmed", "sha2(company_name, 256) AS hash",
    )


def facts(spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None) -> DataFrame:
    return FA.build_facts(raw_cells(spark, sf_dir, ledger), documents(spark, sf_dir))


def decisions(facts: DataFrame, settled: str = "FALSE") -> DataFrame:
    """Two rounds of review over the facts, and a third that accepts what is still rejected where `settled` holds; the last one wins."""
    none = f"CAST(NULL AS {MONEY})"
    row = lambda n, actor, reason, action, value: f"named_struct('event_id', {n}L, 'at', TIMESTAMP'2024-01-0{n} 09:00:00', 'actor', '{actor}', 'reason', '{reason}', 'action', {action}, 'corrected_value', {value})"
    marked = "(document_id + row + col) % 17 = 0"
    first = row(1, "reviewer-a", "checked against the page", f"CASE WHEN parsed.value IS NULL THEN 'correct' WHEN {marked} THEN 'reject' ELSE 'accept' END", f"CASE WHEN parsed.value IS NULL THEN CAST(100 AS {MONEY}) END")
    second = f"CASE WHEN {marked} AND col = 4 THEN {row(2, 'reviewer-b', 'second look', repr('accept'), none)} END"
    third = f"CASE WHEN {marked} AND parsed.value IS NOT NULL AND ({settled}) THEN {row(3, 'reviewer-c', 'settled with the preparer', repr('accept'), none)} END"
    return facts.selectExpr("document_id", "fact_id", f"inline(array_compact(array({first}, {second}, {third})))")


def mapping_log(reviewed: DataFrame) -> DataFrame:
    """Append-only mapping versions: 1 is the system proposal, 2 holds manual batches."""
    v1 = MP.propose_mappings(reviewed, staged=True).withColumn("version", F.lit(1)).drop("score")
    lab = {a: t for a, t in LABELS}
    of = lambda account, label: f"document_id % 14 = 6 AND raw_label = '{lab[label]}' THEN array({', '.join(account)})"
    to = lambda account, value="NULL", kind="one_to_one": f"named_struct('account', '{account}', 'allocation', CAST({value} AS {MONEY}), 'mapping_type', '{kind}')"
    split = ", ".join((to("inventory", "round(value * 0.4, 2)", "split"), to("other_current_assets", "value - round(value * 0.4, 2)", "split")))
    batches = (f"CASE WHEN document_id % 15 = 2 AND raw_label = '{lab['other_current_assets']}' AND col = 6 AND value IS NOT NULL THEN array({split})"
               f" WHEN {of([to('inventory')], 'other_noncurrent_assets')} WHEN {of([to('cogs'), to('gross_profit')], 'cogs')} END")
    v2 = reviewed.selectExpr("document_id", "fact_id", f"inline({batches})").withColumns({"sign": F.lit("as_printed"), "version": F.lit(2)})
    return v1.unionByName(v2)


class Filing:
    """Facts, review and mapping of every derived filing. Facts, reviewed facts and mappings are stage tables clustered on the
    document: they are read many times downstream, so each is materialised once on shared storage, and what joins them moves no row."""

    def __init__(self, spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None, settled: str = "FALSE"):
        self.documents = documents(spark, sf_dir)
        self.facts = cut_lineage(facts(spark, sf_dir, ledger), "document_id")
        self.decisions = decisions(self.facts, settled)
        self.reviewed = cut_lineage(RV.apply_decisions(self.facts, self.decisions), "document_id")

    @cached_property
    def log(self) -> DataFrame:
        return mapping_log(self.reviewed.where("status <> 'rejected'"))

    @cached_property
    def mappings(self) -> DataFrame:
        return cut_lineage(MP.latest_batch(self.log).withColumn("approved", F.expr("document_id % 12 <> 11")), "document_id")
