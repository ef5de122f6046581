"""Registered queries: versioned records, hand-off, partial recomputation, driver files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..money import MONEY
from ..operators import handoff as HO
from ..operators import mapping as MP
from ..operators import metrics as X
from ..session import cut_lineage, stage_root
from ..sources import derived as D
from ..sources import filings as FL
from ..sources import readers as RD
from ..sources.versioned import Versioned
from . import q_filing, q_panel  # noqa: F401  (their common table expressions)
from .duck import sql
from .q_ledger import full
from .q_more import METRICS
from .q_panel import TIED
from .registry import as_double, register, sd


# ---- scenario sets: three writers, one of them too late for some companies ----------------------
def scenario_store(spark, sf):
    rows = D.assumptions(spark, sf).where("scenario_id = 'base'").select("company_id", "scenario_id", "code", "period", "unit", "value", "status")
    rows.write.parquet(source := stage_root(spark))
    rows = spark.read.schema(rows.schema).parquet(source)
    store = Versioned(spark, stage_root(spark), rows.schema, ["company_id"])
    store.write(rows.withColumn("seen_version", F.lit(0)))
    raised = lambda code, by: F.expr(f"CAST(CASE WHEN code = '{code}' THEN value + {by} ELSE value END AS {MONEY})")
    store.write(rows.where("company_id % 2 = 0").withColumn("value", raised("revenue_growth", "0.01")).withColumn("seen_version", F.lit(1)))
    refused = store.write(rows.where("company_id % 3 = 0").withColumn("value", raised("beta", "1")).withColumn("seen_version", F.lit(1)))
    return store, refused


@register("s14_scenario_store", sql(
    "SELECT company_id, code, period, CAST(CASE WHEN company_id % 6 IN (0, 2, 3, 4) THEN 2 ELSE 1 END AS BIGINT) AS version, "
    + sd("CASE WHEN company_id % 2 = 0 AND code = 'revenue_growth' THEN value + 0.01 WHEN company_id % 6 = 3 AND code = 'beta' THEN value + 1 ELSE value END", "value", 6) + " FROM assumption WHERE scenario_id = 'base'", "assumption"))
def s14(spark, sf):
    """What stands after three writers."""
    return as_double(scenario_store(spark, sf)[0].latest().select("company_id", "code", "period", "version", "value"), "value", places=6)


@register("s14_refused_writers", "SELECT s_suppkey AS company_id, CAST(1 AS INTEGER) AS seen, CAST(2 AS BIGINT) AS found FROM supplier WHERE s_suppkey % 6 = 0")
def s14_refused(spark, sf):
    return scenario_store(spark, sf)[1]


# ---- extraction records: nested facts per document, one document in five replaced ----------------
@register("s09_extraction_store", sql(
    "SELECT document_id, fact_id, CAST(CASE WHEN document_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, " + sd("parsed", "value") + ", codes FROM ffacts WHERE document_id % 5 <> 0 OR page = 1", "ffacts"))
def s09(spark, sf):
    """Records written, replaced for some documents, and read back as facts."""
    facts = FL.facts(spark, sf).select("document_id", F.struct("fact_id", "page", "raw_label", "raw_value", "period_label", F.col("parsed.value").alias("value"), "reason_codes").alias("fact"))
    facts.write.parquet(source := stage_root(spark))
    facts = spark.read.schema(facts.schema).parquet(source)
    nested = lambda rows: rows.groupBy("document_id").agg(F.collect_list("fact").alias("facts"))  # noqa: E731  (a document's own facts)
    first = nested(facts)
    store = Versioned(spark, stage_root(spark), first.schema, ["document_id"])
    store.write(first.withColumn("seen_version", F.lit(0)))
    store.write(nested(facts.where("document_id % 5 = 0 AND fact.page = 1")).withColumn("seen_version", F.lit(1)))
    f = store.latest().select("document_id", "version", F.inline("facts"))
    return as_double(f.select("document_id", "fact_id", "version", "value", F.array_join("reason_codes", ",").alias("codes")), "value")


# ---- hand-off -----------------------------------------------------------------------------------
def handoff(spark, sf):
    from .q_panel import evidence, filing

    ledger = cut_lineage(D.tied_ledger(spark, sf), "company_id")
    f = filing(spark, sf, ledger)
    printed, _ = MP.build_ledger(MP.normalise(f.mappings, f.reviewed))
    pages = MP.statement_bookmarks(FL.raw_cells(spark, sf, ledger)).selectExpr("document_id AS company_id", "CASE statement WHEN 'income' THEN 'income_statement' WHEN 'balance' THEN 'balance_sheet' ELSE 'cash_flow_statement' END AS section", "page")
    return HO.publish(cut_lineage(evidence(f), "company_id"), printed, pages, stage_root(spark))


_REFUSED = (f"SELECT company_id, 'displayed_scale is not confirmed' AS reason FROM pevid WHERE NOT ({FL.SCALE_OK}) UNION ALL SELECT company_id, 'reporting_currency is not confirmed' FROM pevid WHERE NOT ({FL.CURRENCY_OK})"
            " UNION ALL SELECT company_id, build_error FROM pevid WHERE build_error IS NOT NULL AND company_id IN (SELECT document_id FROM norm WHERE value IS NOT NULL AND document_id % 12 <> 11)"
            " UNION ALL SELECT company_id, 'no figure to hand over' FROM pevid WHERE company_id NOT IN (SELECT document_id FROM norm WHERE value IS NOT NULL AND document_id % 12 <> 11)")


@register("s21_handoff_refusals", sql(_REFUSED, "pevid", "norm", swap=TIED))
def s21_refusals(spark, sf):
    return handoff(spark, sf)[2]


@register("s21_handoff_ledger", sql(
    f"SELECT document_id AS company_id, statement, account, CAST(period_label AS INTEGER) AS year, {sd('value', 'value')} FROM norm WHERE value IS NOT NULL AND document_id % 12 <> 11 AND document_id NOT IN (SELECT company_id FROM ({_REFUSED}))", "pevid", "norm", swap=TIED))
def s21_ledger(spark, sf):
    """The published ledger: nothing of a refused company is in it."""
    return as_double(handoff(spark, sf)[0].select("company_id", "statement", "account", "year", "value"), "value")


@register("s21_handoff_profile", sql(
    "SELECT document_id AS company_id, CAST(min(CAST(period_label AS INTEGER)) AS INTEGER) AS first_actual, CAST(max(CAST(period_label AS INTEGER)) AS INTEGER) AS last_actual, CAST(max(CAST(period_label AS INTEGER)) + 1 AS INTEGER) AS first_forecast,"
    f" CAST(12 - count(DISTINCT statement) AS INTEGER) AS gaps FROM norm WHERE value IS NOT NULL AND document_id % 12 <> 11 AND document_id NOT IN (SELECT company_id FROM ({_REFUSED})) GROUP BY document_id", "pevid", "norm", swap=TIED))
def s21_profile(spark, sf):
    return handoff(spark, sf)[1].withColumn("gaps", F.size("gaps"))


# ---- partial recomputation ----------------------------------------------------------------------
_X05 = {"gross_margin_pct": "is_gross_profit / nullif(is_revenue, 0) * 100", "payables_cover": "bs_cash / nullif(bs_accounts_payable, 0)", "net_debt": "bs_debt + d - bs_cash", "net_debt_to_ebit": "(bs_debt + d - bs_cash) / nullif(is_ebit, 0)"}


@register("x05_partition_overwrite", sql(" UNION ALL ".join(f"SELECT company_id, year, '{n}' AS metric, {sd(f'CAST({e} AS DECIMAL(20,8))', 'value')} FROM (SELECT *, CASE WHEN company_id % 2 = 0 THEN 100 ELSE 0 END AS d FROM derived)" for n, e in _X05.items()), "derived"))
def x05_overwrite(spark, sf):
    """Debt restated for every second company: its dependents' partitions are replaced, the others stay as written."""
    path, rows = stage_root(spark), full(spark, sf)
    X.overwrite_affected(rows, METRICS, None, path)
    restated = rows.withColumn("bs_debt", F.expr(f"CAST(CASE WHEN company_id % 2 = 0 THEN bs_debt + 100 ELSE bs_debt END AS {MONEY})"))
    return as_double(X.overwrite_affected(restated, METRICS, ["bs_debt"], path).select("company_id", "year", "metric", "value"), "value")


# ---- driver files -------------------------------------------------------------------------------
_YEARS = [f"{y}E" for y in D.FORECAST_YEARS]


def driver_files(spark, sf):
    """One file row per company from its base assumptions, some with a fault in one block."""
    a = D.assumptions(spark, sf).where("scenario_id = 'base' AND unit = 'ratio'").groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("seq", "code", "period", "value"))).alias("rows"))
    text = "CASE WHEN company_id % 7 = 3 AND r.code = 'capex_pct_revenue' THEN '0.123456789' WHEN company_id % 7 = 4 AND r.code = 'capex_pct_revenue' THEN 'seven' ELSE CAST(r.value AS STRING) END"
    basis = "CASE WHEN company_id % 7 = 5 AND r.code = 'sbc_pct_revenue' THEN 'a hunch' ELSE 'model_assumption' END"
    year = "CASE WHEN company_id % 7 = 6 AND r.period = 2003 THEN '1990E' WHEN r.period IS NOT NULL THEN concat(r.period, 'E') END"
    drivers = f"transform(rows, r -> named_struct('name', r.code, 'value', {text}, 'basis', {basis}, 'source', 'base case', 'year', {year}, 'note', CAST(NULL AS STRING)))"
    twice = "transform(filter(rows, r -> r.code = 'terminal_growth' AND company_id % 7 = 2), r -> named_struct('name', r.code, 'value', '0.01', 'basis', 'model_assumption', 'source', 'again', 'year', CAST(NULL AS STRING), 'note', CAST(NULL AS STRING)))"
    conflict = ("array(named_struct('topic', 'capex', 'source_a', '10-K', 'date_a', '2002-02-01', 'value_a', '120', 'source_b', 'Deck', 'date_b', '2002-03-15', 'value_b', '130',"
                " 'chosen', CASE WHEN company_id % 5 = 1 THEN 'a call' ELSE '10-K' END, 'rationale', CASE WHEN company_id % 5 = 2 THEN ' ' ELSE 'audited' END))")
    rates = "map_from_arrays(array('2002E', '2003E', '2004E', '2005E', '2006E'), array('0.25', '0.25', CASE WHEN company_id % 5 = 3 THEN NULL ELSE '0.25' END, '0.25', '0.25'))"
    tax = f"CASE WHEN company_id % 9 <> 8 THEN named_struct('basis', 'statutory', 'source', 'note 9', 'rates', {rates}) END"
    out = a.selectExpr("CAST(company_id AS STRING) AS company_id", f"concat({drivers}, {twice}) AS drivers", f"{conflict} AS conflicts", f"{tax} AS tax", "map('north', '10.5', 'south', CASE WHEN company_id % 8 = 1 THEN '1e' ELSE '7' END) AS segments")
    out.write.json(path := stage_root(spark))
    return RD.read_drivers(spark, path, _YEARS)


_A = "(SELECT * FROM assumption WHERE scenario_id = 'base' AND unit = 'ratio')"
_DRIVER_REASON = ("CASE WHEN company_id % 7 = 5 AND code = 'sbc_pct_revenue' THEN 'unknown basis' WHEN company_id % 7 = 6 AND period = 2003 THEN 'not a modelled year' WHEN company_id % 7 = 3 AND code = 'capex_pct_revenue' THEN 'value: more decimals than are kept'"
                  " WHEN company_id % 7 = 4 AND code = 'capex_pct_revenue' THEN 'value: not a decimal' WHEN company_id % 7 = 2 AND code = 'terminal_growth' THEN 'declared twice' END")


@register("s03_read_drivers", sql(
    f"SELECT CAST(company_id AS VARCHAR) AS company_id, code AS name, CASE WHEN period IS NOT NULL THEN period || 'E' END AS year, {sd('value', 'value', 6)} FROM {_A} WHERE {_DRIVER_REASON} IS NULL", "assumption"))
def s03(spark, sf):
    return as_double(driver_files(spark, sf)["drivers"].select("company_id", "name", "year", "value"), "value", places=6)


@register("s03_refused_inputs", sql(
    "SELECT CAST(company_id AS VARCHAR) AS company_id, block, item, reason FROM ("
    f"SELECT company_id, 'drivers' AS block, code || CASE WHEN period = 2003 AND company_id % 7 = 6 THEN ' 1990E' WHEN period IS NOT NULL THEN ' ' || period || 'E' ELSE '' END AS item, {_DRIVER_REASON} AS reason FROM {_A}"
    f" UNION ALL SELECT company_id, 'drivers', code, 'declared twice' FROM {_A} WHERE company_id % 7 = 2 AND code = 'terminal_growth'"
    " UNION ALL SELECT company_id, 'conflicts', 'capex', CASE company_id % 5 WHEN 1 THEN 'chosen is neither source' WHEN 2 THEN 'not given: rationale' END FROM (SELECT DISTINCT company_id FROM " + _A + ")"
    " UNION ALL SELECT company_id, 'tax', y || 'E', CASE WHEN company_id % 9 = 8 THEN 'no tax block' WHEN company_id % 5 = 3 AND y = 2004 THEN 'no rate for the year' END FROM (SELECT DISTINCT company_id FROM " + _A + "), (SELECT unnest(range(2002, 2007)) AS y)"
    " UNION ALL SELECT company_id, 'segments', 'south', CASE WHEN company_id % 8 = 1 THEN 'value: not a decimal' END FROM (SELECT DISTINCT company_id FROM " + _A + ")) WHERE reason IS NOT NULL", "assumption"))
def s03_refused(spark, sf):
    return driver_files(spark, sf)["refused"]
