"""Raw page-table cells to located, parsed, scored facts.

raw_cell: document_id, page, table_id, row, col, text, caption. A table is bounded by its page, so
windows over one table stay small; everything is clustered once on document_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import dims
from ..functions import amounts as A
from ..functions import labels as LB
from ..layers import settle, spread

TABLE = ["document_id", "table_id"]


def clustered(cells: DataFrame) -> DataFrame:
    """Clustered on the document, as all that follows is: joins and groupings by document and more move no cell again."""
    return spread(cells, "document_id")


def header_rows(cells: DataFrame) -> DataFrame:
    """Adds the period each cell names, its row's label, and the table's header row."""
    row, table = Window.partitionBy(*TABLE, "row"), Window.partitionBy(*TABLE)
    c = clustered(cells).withColumns({"text": A.strip(F.coalesce("text", F.lit(""))), "period": LB.period_label(F.col("text"))})
    c = settle(c, [x for x in cells.columns if x != "text"])
    is_period = (F.col("col") >= 1) & F.col("period.label").isNotNull()
    c = c.withColumns(
        {
            "row_periods": F.count_if(is_period).over(row),
            "row_label": F.max(F.when(F.col("col") == 0, F.col("text"))).over(row),
        }
    )
    qualifies = ((F.col("row_periods") >= 1) & (F.coalesce("row_label", F.lit("")) == "")) | (F.col("row_periods") >= 2)
    # a repeat of the header reads as it does, so other rows need no text
    c = c.withColumn("row_text", F.sort_array(F.collect_list(F.when(qualifies, F.struct("col", "text"))).over(row)))
    c = c.withColumn("header_row", F.min(F.when(qualifies, F.col("row"))).over(table))
    c = c.withColumn("header_text", F.max(F.when(F.col("row") == F.col("header_row"), F.col("row_text"))).over(table))
    repeated = (F.col("row") != F.col("header_row")) & (F.col("row_text") == F.col("header_text"))
    c = c.withColumn("is_repeat", F.coalesce(repeated, F.lit(False)))
    return c.withColumns(
        {
            "has_repeats": F.max("is_repeat").over(table),
            "first_value_column": F.coalesce(F.min(F.when((F.col("row") == F.col("header_row")) & is_period, F.col("col"))).over(table), F.lit(1)),
            "column_period": F.max(F.when(F.col("row") == F.col("header_row"), F.col("period"))).over(Window.partitionBy(*TABLE, "col")),
        }
    )


def table_splits(cells: DataFrame) -> DataFrame:
    """Tables that continue the previous page: headerless, next page, same column count."""
    t = header_rows(cells).groupBy("document_id", "table_id").agg(
        F.min("page").alias("page"), F.min("header_row").alias("header_row"), (F.max("col") + 1).alias("columns")
    )
    prev = F.lag(F.struct("page", "header_row", "columns")).over(Window.partitionBy("document_id").orderBy("page", "table_id"))
    return t.withColumn("prev", prev).select(
        "document_id", "table_id", "page", "header_row", "columns",
        F.coalesce(
            F.col("header_row").isNull() & F.col("prev.header_row").isNotNull() & (F.col("page") == F.col("prev.page") + 1) & (F.col("columns") == F.col("prev.columns")),
            F.lit(False),
        ).alias("continues"),
    )


def value_cells(cells: DataFrame) -> DataFrame:
    """Body cells under a period heading; section headings and repeated headers are dropped."""
    h = header_rows(cells).where("header_row IS NOT NULL AND row > header_row AND NOT is_repeat")
    v = h.where("col >= 1 AND column_period.label IS NOT NULL")
    any_text = F.max(F.col("text") != "").over(Window.partitionBy(*TABLE, "row"))
    return v.withColumn("row_has_value", any_text).where("row_has_value").drop("row_has_value")


EVIDENCE = ("text_layer", "in_table", "row_label", "column_period", "parsed", "sign_explicit", "clean_numeric", "table_intact")


def _evidence() -> dict[str, Column]:
    return {
        "text_layer": F.lit(True),
        "in_table": F.lit(True),
        "row_label": F.coalesce(F.trim("raw_label"), F.lit("")) != "",
        "column_period": F.col("period_label").isNotNull() & ~F.col("period_ambiguous"),
        "parsed": F.col("parsed.value").isNotNull(),
        "sign_explicit": F.col("parsed.sign_source") != "unresolved",
        "clean_numeric": F.size("parsed.markers") == 0,
        "table_intact": ~F.col("has_repeats"),
    }


def build_facts(cells: DataFrame, documents: DataFrame, threshold: str = dims.REVIEW_THRESHOLD) -> DataFrame:
    """Facts with reason codes and confidence.

    documents: document_id, locale, scale_confirmed, currency_confirmed.
    """
    v = value_cells(cells).select(
        "document_id", "page", "table_id", "row", "col", F.col("row_label").alias("raw_label"), F.col("text").alias("raw_value"), "caption",
        F.col("column_period.label").alias("period_label"), F.col("column_period.ambiguous").alias("period_ambiguous"), "has_repeats",
    )
    d = v.join(documents.select("document_id", "locale", "scale_confirmed", "currency_confirmed"), "document_id", "left")
    d = A.parse_amounts(d)
    d = d.withColumns({"scope": LB.scope_of_caption(F.col("caption")), "statement": LB.statement_of_caption(F.col("caption"))})
    ev = _evidence()
    score = sum((c.cast("int") for c in list(ev.values())[1:]), list(ev.values())[0].cast("int"))
    d = d.withColumns(
        {
            "confidence": (score / F.lit(8)).cast("decimal(5,4)"),
            "failed_evidence": F.array_compact(F.array(*[F.when(~c, n) for n, c in ev.items()])),
        }
    )
    d = settle(d, v.columns)
    codes = F.concat(
        "parsed.codes",
        F.array_compact(
            F.array(
                F.when(~F.coalesce("scale_confirmed", F.lit(False)), "SCALE_UNCONFIRMED"),
                F.when(~F.coalesce("currency_confirmed", F.lit(False)), "CURRENCY_UNCONFIRMED"),
                F.when(F.col("period_ambiguous"), "PERIOD_AMBIGUOUS"),
                F.when(F.col("scope") == "undetermined", "SCOPE_AMBIGUOUS"),
                F.when(F.col("has_repeats"), "HEADER_REPEATED"),
                F.when(F.col("confidence") < F.lit(threshold).cast("decimal(5,4)"), "LOW_CONFIDENCE"),
            )
        ),
    )
    d = d.withColumn("reason_codes", F.array_distinct(codes))
    d = d.withColumns(
        {
            "fact_id": F.concat_ws("-", "table_id", "row", "col"),
            "needs_review": (F.col("confidence") < F.lit(threshold).cast("decimal(5,4)")) | F.arrays_overlap("reason_codes", F.array(*map(F.lit, dims.BLOCKING))),
        }
    ).drop("locale", "scale_confirmed", "currency_confirmed", "has_repeats")
    return settle(d, ["document_id", "table_id", "page", "row", "col"])


def outstanding(codes: str = "reason_codes", resolved: str = "resolved_codes") -> Column:
    """Blocking codes not yet resolved."""
    return F.array_except(F.array_intersect(F.col(codes), F.array(*map(F.lit, dims.BLOCKING))), F.coalesce(F.col(resolved), F.array().cast("array<string>")))


def effective_value() -> Column:
    """The correction if there is one, else the parse."""
    return F.coalesce(F.col("corrected_value"), F.col("parsed.value"))


def confidence_histogram(facts: DataFrame) -> DataFrame:
    return facts.groupBy("document_id", "confidence").agg(F.count("*").alias("facts"), F.min("fact_id").alias("example"))


def review_queue(facts: DataFrame) -> DataFrame:
    """Outstanding blocking codes per fact, with their meaning."""
    r = F.broadcast(dims.reason_df(facts.sparkSession))
    return (
        facts.select("document_id", "page", "fact_id", "raw_label", "raw_value", F.explode(outstanding()).alias("code"))
        .join(r, "code")
        .select("document_id", "page", "fact_id", "raw_label", "raw_value", "code", "summary")
    )
