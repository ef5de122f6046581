"""Keeping layered projections linear, and heavy steps on all partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def settle(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Compute the columns outside `keep` once, here.

    A one-row stack() passes them on: it stays inside code generation, and later filters and
    projections refer to its output instead of inlining the expressions behind it, which for
    layered text rules would grow with every reference.
    """
    new = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.stack(F.lit(1), *[F.col(c) for c in new]).alias(*new))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Clustered on the keys over all shuffle partitions of the session, for a step whose work or memory is not told by the bytes that come
    in: partitions merged by bytes come out as one more than there are cores, so most cores wait for the last, and grow with the input."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
