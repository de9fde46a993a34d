"""Spatial joins inside a key (a frame or rally): each key's rows meet only each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalars import distance


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], right_id: str, limit: float) -> DataFrame:
    """Each left row with the nearest right row of its key inside `limit`: adds `near_id` and `near_distance` (null if none; of equals the least id)."""
    r = right.select(*keys, F.col(right_id).alias("_rid"), F.col(right_xy[0]).alias("_rx"), F.col(right_xy[1]).alias("_ry"))
    d = distance(F.col(left_xy[0]), F.col(left_xy[1]), F.col("_rx"), F.col("_ry"))
    pairs = left.join(r, keys).withColumn("_d", d).where(F.col("_d") < limit)
    best = pairs.groupBy(*keys, left_id).agg(F.min(F.struct("_d", "_rid")).alias("_best"))
    return left.join(best, [*keys, left_id], "left").withColumns({"near_id": F.col("_best._rid"), "near_distance": F.col("_best._d")}).drop("_best")


def any_within(left: DataFrame, right: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """The left rows for which some right row of their key satisfies `condition`. right: columns of other names."""
    r = right.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = condition
    for n, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{n}"))
    return left.join(r, on, "left_semi")


def count_within(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, condition: Column, name: str) -> DataFrame:
    """How many right rows of its key satisfy `condition` with each left row (0 without any). right: columns of other names."""
    n = left.join(right, keys).where(condition).groupBy(*keys, left_id).agg(F.count(F.lit(1)).alias(name))
    return left.join(n, [*keys, left_id], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, score: Column, right_id: str, least: float) -> DataFrame:
    """Each left row's right row of the highest score of at least `least`: (keys, left_id, right_id, score), of equals the least id."""
    pairs = left.join(right, keys).withColumn("_s", score).where(F.col("_s") >= least)
    w = Window.partitionBy(*keys, left_id).orderBy(F.desc("_s"), right_id)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, left_id, right_id, F.col("_s").alias("score"))


def homography(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> list[float]:
    """The 9 coefficients that map four points to four others, the last one 1."""
    import numpy as np

    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0]
