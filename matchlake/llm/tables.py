"""Intermediate results in the cluster's shared folder, and a few column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.operators.tables import fresh_path, remove, saved, shared_dir  # noqa: F401

#: Rows of a side that may be broadcast after they were counted.
BROADCAST_ROWS = 200_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted and is small; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text: Column) -> Column:
    """A 64-bit content key of a text; null has its own."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def same(*pairs: tuple[Column, Column]) -> Column:
    """Null-safe equality of all pairs."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out
