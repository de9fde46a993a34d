"""Places and running sums over large groups, without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.tables import saved

#: Rows of one window at most (for `running` with distinct places).
WIDTH = 1024


def ranked(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with each row's place (0, 1, ...) in the order of the whole table.

    Rows are dealt by ranges of the order and sorted within; a row's place is
    its place in its range and the number of rows in the ranges before.  Only
    one number for each range goes to the driver.  Rows that tie are placed
    one after the other as they come: give an order without ties where that matters.
    Null keys stand where the order puts them; an empty table stays empty.
    """
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, at = f"_{name}_range", f"_{name}_at"
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = saved(cut.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = dict(cut.groupBy(part).count().collect())
    starts, total = [], 0
    for k in sorted(sizes):
        starts.append((k, total))
        total += sizes[k]
    table = df.sparkSession.createDataFrame(starts, f"{part} int, {name} long")
    return cut.join(F.broadcast(table), part).select(*df.columns, (F.col(name) + F.col(at)).alias(name))


def running(df: DataFrame, keys: list[str], at: str, value: str, name: str = "before") -> DataFrame:
    """df with the sum of `value` over the rows of the same keys at smaller places `at`.

    `at` is an integer of 0 or more, distinct within keys.  Sums are taken of WIDTH
    places, of WIDTH such sums and so on, so that no window is longer than WIDTH rows,
    whatever a key's share of the rows.
    """
    return _running(df, keys, at, value, name, df.agg(F.max(at)).first()[0] or 0)


def _running(df: DataFrame, keys: list[str], at: str, value: str, name: str, most: int) -> DataFrame:
    upto = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    if most < WIDTH:
        return df.withColumn(name, F.coalesce(F.sum(value).over(upto.partitionBy(*keys)), F.lit(0)))
    high, over = f"_{at}_{most}", f"_{name}_{most}"
    cut = df.withColumn(high, F.floor(F.col(at) / WIDTH))
    sums = _running(cut.groupBy(*keys, high).agg(F.sum(value).alias(value)), keys, high, value, over, most // WIDTH)
    inner = cut.withColumn(name, F.coalesce(F.sum(value).over(upto.partitionBy(*keys, high)), F.lit(0)))
    return inner.join(sums.drop(value), [*keys, high]).withColumn(name, F.col(name) + F.col(over)).drop(high, over)
