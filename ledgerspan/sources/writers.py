"""Output tables, CSV defence against formulas, JSON cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType, StringType

from ..money import survives_double

# First characters a spreadsheet reads as a formula.
DANGEROUS = ("=", "+", "-", "@", "\t", "\r")


def is_dangerous(c: Column) -> Column:
    return F.substring(c, 1, 1).isin(*DANGEROUS)


def neutralised(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run are quoted; numeric cells are left alone."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(is_dangerous(F.col(c)), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) for c in text})


def neutralised_cells(df: DataFrame, key: str) -> DataFrame:
    """Which text cells were defused."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != key]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in text])
    return df.select(key, F.inline(cells)).where(is_dangerous(F.col("text")))


def plain_decimals(df: DataFrame) -> DataFrame:
    """Decimals as exact text, for sinks without a decimal type."""
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, DecimalType)})


def json_cells(df: DataFrame, key: list[str], value: str, note: str) -> DataFrame:
    """Cells as {value, absent, note} JSON with values as text."""
    return df.select(*key, F.to_json(F.struct(F.col(value).cast("string").alias("value"), F.col(value).isNull().alias("absent"), F.col(note).alias("note"))).alias("cell"))


def double_losses(df: DataFrame, value: str) -> DataFrame:
    """Exact decimals that would not come back from a 16-digit double."""
    return df.where(F.col(value).isNotNull() & ~survives_double(F.col(value)))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One output table. Overwrite replaces only the partitions being written."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = plain_decimals(neutralised(df)).write.mode(mode).format(fmt).option("header", True)
    elif fmt == "json":
        w = plain_decimals(df).write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def export_tables(tables: dict[str, DataFrame], root: str, metadata: dict[str, str], fmt: str = "parquet", unavailable: dict[str, str] | None = None) -> None:
    """One folder per table, plus a side table with version, units and unavailable tables."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", fmt=fmt)
    rows = [(n, "available", "") for n in tables] + [(n, "unavailable", r) for n, r in (unavailable or {}).items()]
    status = spark.createDataFrame(rows, "table_name string, state string, reason string")
    write_table(status.coalesce(1), f"{root}/_tables", fmt=fmt)
    write_table(spark.createDataFrame(list(metadata.items()), "field string, value string").coalesce(1), f"{root}/_metadata", fmt=fmt)


def validate_export(path_df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Rows whose JSON does not match the declared schema."""
    parsed = F.from_json(F.col(payload), schema + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return path_df.withColumn("_p", parsed).where("_p._corrupt IS NOT NULL").drop("_p")
