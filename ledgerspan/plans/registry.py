"""Named queries and the SQL an independent engine runs for the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def dbl(c: Column | str, places: int = 4) -> Column:
    """Reporting form of a decimal: rounded, then double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places).cast("double")


def as_double(df: DataFrame, *cols: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: dbl(c, places) for c in cols})


def sd(expr: str, name: str, places: int = 4) -> str:
    """The SQL counterpart of dbl."""
    return f"CAST(round({expr}, {places}) AS DOUBLE) AS {name}"
