"""Typed reads. Amounts arrive as text and are cast once; what is not a number is set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import dims
from ..money import MONEY, exact_decimal, to_decimal

# One schema per input table; values are text on read, never inferred.
REPORTED = "company_id STRING, statement STRING, account STRING, year INT, value STRING, document STRING, page INT, line_item STRING"
NESTED_REPORTED = "company_id STRING, statement STRING, account STRING, document STRING, page INT, line_item STRING, values MAP<STRING, STRING>"
COMPANY = "company_id STRING, name STRING, reporting_period STRING, fiscal_year_end STRING, currency STRING, units STRING, audited BOOLEAN, pages MAP<STRING, INT>, historical ARRAY<STRING>, forecast ARRAY<STRING>"
DRIVER = "company_id STRING, scenario_id STRING, code STRING, period INT, unit STRING, value STRING, status STRING, source_type STRING, source STRING, note STRING, seq INT"
VALUATION = "company_id STRING, scenario_id STRING, inputs MAP<STRING, STRING>, sources MAP<STRING, STRING>, wacc_axis ARRAY<STRING>, growth_axis ARRAY<STRING>"
SCENARIO = "company_id STRING, scenario_id STRING, parent_id STRING, name STRING, description STRING"
RAW_CELL = "document_id STRING, page INT, table_id STRING, row INT, col INT, text STRING, caption STRING"
RESULT = (
    "document_id STRING, company_id STRING, facts ARRAY<STRUCT<fact_id: STRING, page: INT, raw_label: STRING, raw_value: STRING, period_label: STRING, value: STRING, reason_codes: ARRAY<STRING>>>,"
    " mappings ARRAY<STRUCT<fact_id: STRING, account: STRING, mapping_type: STRING, sign: STRING, allocation: STRING, approved_by: STRING>>,"
    " audit ARRAY<STRUCT<event_id: BIGINT, at: STRING, actor: STRING, action: STRING, entity_id: STRING, detail: STRING>>"
)
DRIVER_FILE = (
    "company_id STRING, drivers ARRAY<STRUCT<name: STRING, value: STRING, basis: STRING, source: STRING, year: STRING, note: STRING>>,"
    " conflicts ARRAY<STRUCT<topic: STRING, source_a: STRING, date_a: STRING, value_a: STRING, source_b: STRING, date_b: STRING, value_b: STRING, chosen: STRING, rationale: STRING>>,"
    " tax STRUCT<basis: STRING, source: STRING, rates: MAP<STRING, STRING>>, segments MAP<STRING, STRING>"
)
FORMATS = ("json", "csv", "parquet", "orc")


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt}")
    if fmt == "csv":
        options.setdefault("header", True)
    return spark.read.options(**options).schema(schema).format(fmt).load(path)


def quarantine(rows: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose text is a finite decimal, and the rest with the text kept."""
    d = rows.withColumn("_v", to_decimal(F.col(value)))
    good = d.where("_v IS NOT NULL").withColumn(value, F.col("_v")).drop("_v")
    bad = d.where(F.col("_v").isNull() & F.col(value).isNotNull()).drop("_v")
    return good, bad


def read_reported(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Nested per-account values exploded to rows; a null year is skipped; unknown accounts and
    unreadable figures go to the second table with the reason (S01)."""
    n = read(spark, path, NESTED_REPORTED, fmt)
    rows = n.select("company_id", "statement", "account", "document", "page", "line_item", F.explode("values").alias("label", "value")).where("value IS NOT NULL")
    rows = rows.withColumn("year", F.regexp_extract("label", r"^(\d{4})[AE]?$", 1).try_cast("int"))
    chart = F.broadcast(dims.chart_df(spark).select("statement", "account", F.lit(True).alias("known")))
    j = rows.join(chart, ["statement", "account"], "left").withColumn("_v", to_decimal(F.col("value")))
    problem = F.when(F.col("known").isNull(), "unknown account").when(F.col("year").isNull(), "unknown year").when(F.col("_v").isNull(), "not a decimal")
    j = j.withColumn("problem", problem)
    good = j.where("problem IS NULL").select("company_id", "statement", "account", "year", F.col("_v").alias("value"), F.lit("reported").alias("origin"), F.struct("document", "page", "line_item").alias("source"))
    return good, j.where("problem IS NOT NULL").select("company_id", "statement", "account", "label", "value", "problem")


def read_company(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(company, period, source map rows)."""
    c = read(spark, path, COMPANY, fmt)
    periods = c.select("company_id", F.posexplode(F.concat("historical", "forecast")).alias("ordinal", "label")).withColumns({"year": F.substring("label", 1, 4).try_cast("int"), "kind": F.substring("label", -1, 1)})
    pages = c.select("company_id", F.explode("pages").alias("section", "page"))
    return c.drop("historical", "forecast", "pages"), periods, pages


def period_violations(periods: DataFrame) -> DataFrame:
    """Suffix, duplicate, gap and order rules of a period axis."""
    w = "OVER (PARTITION BY company_id ORDER BY ordinal)"
    return periods.selectExpr("*", f"lag(year) {w} AS py", f"lag(kind) {w} AS pk").withColumn(
        "problem",
        F.when(~F.col("label").rlike(r"^\d{4}[AE]$"), "bad label").when(F.col("py") == F.col("year"), "duplicate").when(F.col("year") != F.col("py") + 1, "gap or disorder")
        .when((F.col("pk") == "E") & (F.col("kind") == "A"), "actual after estimate"),
    ).where("problem IS NOT NULL").drop("py", "pk")


def source_map_gaps(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """Required sections without a page."""
    need = companies.select("company_id").selectExpr("company_id", "explode(array(" + ", ".join(f"'{s}'" for s in dims.REQUIRED_SECTIONS) + ")) AS section")
    return need.join(pages.where("page IS NOT NULL"), ["company_id", "section"], "left_anti")


def read_valuation(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Wide valuation inputs; only the five optional claims default to zero."""
    v = read(spark, path, VALUATION, fmt)
    optional = {"non_operating_investments", "minority_interest", "preferred_stock", "pension_obligations", "other_claims"}
    cols = {c: to_decimal(F.try_element_at("inputs", F.lit(c))) for c in [m[0] for m in dims.MARKET_INPUTS] + ["tax_rate", "cash", "debt"]}
    cols = {c: F.coalesce(e, F.lit(0).cast(MONEY)) if c in optional else e for c, e in cols.items()}
    return v.withColumns(cols)


def required_fields(df: DataFrame, fields: list[str], key: str = "company_id") -> DataFrame:
    """(key, field) for every required field that is absent or blank."""
    gaps = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields]))
    return df.select(key, F.explode(gaps).alias("field"))


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Stored extraction results as normalised tables."""
    r = spark.read.schema(RESULT).option("multiLine", True).json(path)
    return {
        "document": r.select("document_id", "company_id"),
        "fact": r.select("document_id", F.inline("facts")).withColumn("value", to_decimal(F.col("value"))),
        "mapping": r.select("document_id", F.inline("mappings")).withColumn("allocation", to_decimal(F.col("allocation"))),
        "audit": r.select("document_id", F.inline("audit")).withColumn("at", F.to_timestamp("at")),
    }


def file_intake(spark: SparkSession, path: str, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Accept or refuse files by size, signature and end marker (S10). Oversized files are judged by
    their listed length alone: their bytes are not read."""
    files = spark.read.format("binaryFile").load(path)
    big = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("version"), F.lit("ING-020-08").alias("refusal"))
    c = files.where(F.col("length") <= max_bytes)
    head, tail = F.expr("decode(substring(content, 1, 8), 'ISO-8859-1')"), F.expr("decode(substring(content, greatest(length(content) - 1023, 1), 1024), 'ISO-8859-1')")
    refusal = F.when((F.col("length") == 0) | ~head.startswith("%PDF-"), "ING-010-01").when(~F.contains(tail, F.lit("%%EOF")), "ING-010-02")
    ok = c.select("path", "length", F.sha2("content", 256).alias("hash"), F.nullif(F.regexp_extract(head, r"%PDF-(\d\.\d)", 1), F.lit("")).alias("version"), refusal.alias("refusal"))
    return ok.unionByName(big)


def dedupe_by_hash(files: DataFrame, registry: DataFrame) -> DataFrame:
    """First upload of a hash per company is kept; repeats are refused unless linked with a reason."""
    first = files.groupBy("company_id", "hash").agg(F.min(F.struct("uploaded_at", "file_id")).alias("f"))
    known = registry.select("company_id", "hash").distinct().withColumn("stored", F.lit(True))
    j = files.join(first, ["company_id", "hash"]).join(known, ["company_id", "hash"], "left")
    dup = (F.col("file_id") != F.col("f.file_id")) | F.coalesce("stored", F.lit(False))
    return j.withColumn("refusal", F.when(dup & (F.coalesce(F.trim("link_reason"), F.lit("")) == ""), "ING-010-03")).drop("f", "stored")


def verify_hashes(found: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """match, mismatch, missing or extra per file."""
    j = found.select(key, F.col("hash").alias("found")).join(manifest.select(key, F.col("hash").alias("recorded")), key, "full_outer")
    return j.withColumn("state", F.when(F.col("found").isNull(), "missing").when(F.col("recorded").isNull(), "extra").when(F.col("found") == F.col("recorded"), "match").otherwise("mismatch"))


def read_drivers(spark: SparkSession, path: str, forecast_years: list[str], fmt: str = "json", actual_years: list[str] = ()) -> dict[str, DataFrame]:
    """The four blocks of driver files and what they refuse (S03, P41, P39): drivers, conflicts, tax, segments, refused.

    refused: company_id, block, item, reason. A row with a problem is in no block; nothing is rounded, filled or dropped silently.
    Two drivers of one name and year refuse each other."""
    raw = read(spark, path, DRIVER_FILE, fmt)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""

    def absent(names: str, row: str = "") -> Column:
        gaps = F.array_join(F.array_compact(F.array(*[F.when(blank(F.col(row + n)), n) for n in names.split()])), ", ")
        return F.when(gaps != "", F.concat(F.lit("not given: "), gaps))

    value, wrong = exact_decimal(F.col("value"))
    d = raw.select("company_id", F.inline("drivers")).withColumns({"_value": value, "_wrong": wrong})
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("company_id", "name", "year")))
    years = [*actual_years, *forecast_years]
    d = d.withColumn("reason", F.coalesce(
        absent("name value basis source"), F.when(~F.lower(F.trim("basis")).isin(*sorted(set(dims.ENGINE_BASIS.values()))), "unknown basis"),
        F.when(F.col("year").isNotNull() & ~F.col("year").isin(*years), "not a modelled year"), F.concat(F.lit("value: "), F.col("_wrong")), F.when(F.col("_n") > 1, "declared twice")))
    c = raw.select("company_id", F.inline("conflicts"))
    c = c.withColumn("reason", F.coalesce(
        absent("topic source_a date_a value_a source_b date_b value_b chosen rationale"), F.when((F.col("chosen") != F.col("source_a")) & (F.col("chosen") != F.col("source_b")), "chosen is neither source")))
    head = absent("basis source", "tax.")
    t = raw.select("company_id", "tax", F.when(F.col("tax").isNull(), "no tax block").otherwise(head).alias("_head"), F.explode(F.array(*map(F.lit, forecast_years))).alias("year"))
    rate, wrong = exact_decimal(F.try_element_at("tax.rates", F.col("year")))
    t = t.select("company_id", "year", F.col("tax.basis").alias("basis"), F.col("tax.source").alias("source"), rate.alias("rate"), F.coalesce("_head", F.when(F.try_element_at("tax.rates", F.col("year")).isNull(), "no rate for the year"), F.concat(F.lit("rate: "), wrong)).alias("reason"))
    s = raw.select("company_id", F.explode("segments").alias("segment", "value"))
    value, wrong = exact_decimal(F.col("value"))
    s = s.select("company_id", "segment", value.alias("base_revenue"), F.concat(F.lit("value: "), wrong).alias("reason"))
    refused = [x.where("reason IS NOT NULL").select("company_id", F.lit(b).alias("block"), i.alias("item"), "reason")
               for b, x, i in (("drivers", d, F.concat_ws(" ", "name", "year")), ("conflicts", c, F.col("topic")), ("tax", t, F.col("year")), ("segments", s, F.col("segment")))]
    good = lambda x: x.where("reason IS NULL").drop("reason")
    return {
        "drivers": good(d).withColumn("value", F.col("_value")).drop("_value", "_wrong", "_n"), "conflicts": good(c), "tax": good(t), "segments": good(s),
        "refused": refused[0].unionByName(refused[1]).unionByName(refused[2]).unionByName(refused[3]),
    }
