"""As-of joins by key and time as window functions over the union of both sides.

Both sides are shuffled once by the key and sorted; no pairs are built, so a
key's rows cost a sort and not a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sided(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str]) -> DataFrame:
    a = left.select(*keys, F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.col(left_time).alias("_t"), F.lit(None).alias("_hit"))
    hit = F.struct(F.col(right_time).alias("_t"), *[F.col(c) for c in payload])
    b = right.select(*keys, F.col(right_time).alias("_t"), hit.alias("_hit"))
    return a.drop("_hit").unionByName(b, allowMissingColumns=True)


def _finished(rows: DataFrame, left: DataFrame, payload: list[str], hit: Column, prefix: str) -> DataFrame:
    out = rows.withColumn("_found", hit).where("_row is not null")
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in left.columns], F.col("_found._t").alias(f"{prefix}time"), *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in payload])


def _windows(keys: list[str]):
    w = Window.partitionBy(*keys).orderBy("_t")
    return w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing), w.rangeBetween(Window.unboundedPreceding, -1)




def backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], within=None, prefix: str = "asof_") -> DataFrame:
    """Each left row with the right row of its key of the latest time <= its own (within: at most so far back).

    Right times must be unique within a key; without a match the added columns are null.
    """
    back, _, _ = _windows(keys)
    rows = _sided(left, right, keys, left_time, right_time, payload)
    hit = F.last("_hit", ignorenulls=True).over(back)
    if within is not None:
        hit = F.when(F.col("_t") - hit["_t"] <= within, hit)
    return _finished(rows, left, payload, hit, prefix)


def forward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], within=None, strict: bool = False, prefix: str = "asof_") -> DataFrame:
    """Each left row with the right row of the earliest time >= its own (strict: later), at most `within` ahead."""
    rows = _sided(left, right, keys, left_time, right_time, payload)
    frame = Window.partitionBy(*keys).orderBy("_t").rangeBetween(1 if strict else 0, Window.unboundedFollowing)
    hit = F.first("_hit", ignorenulls=True).over(frame)
    if within is not None:
        hit = F.when(hit["_t"] - F.col("_t") <= within, hit)
    return _finished(rows, left, payload, hit, prefix)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], within=None, prefix: str = "asof_") -> DataFrame:
    """Each left row with the right row of the nearest time; of two as near, the earlier."""
    rows = _sided(left, right, keys, left_time, right_time, payload)
    back, ahead, _ = _windows(keys)
    before, after = F.last("_hit", ignorenulls=True).over(back), F.first("_hit", ignorenulls=True).over(ahead)
    rows = rows.withColumn("_before", before).withColumn("_after", after)
    gap_before, gap_after = F.col("_t") - F.col("_before._t"), F.col("_after._t") - F.col("_t")
    hit = F.when(F.col("_after").isNull() | (gap_before <= gap_after), F.col("_before")).otherwise(F.col("_after"))
    if within is not None:
        hit = F.when(F.abs(hit["_t"] - F.col("_t")) <= within, hit)
    return _finished(rows, left, payload, hit, prefix)
