"""Set operations, upserts and range-scoped overwrites as joins that give a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_ignoring_case(parts: list[DataFrame], value: str) -> DataFrame:
    """Distinct trimmed values regardless of case; the first spelling of the first part stays; blanks go."""
    rows = None
    for k, p in enumerate(parts):
        part = p.select(F.trim(F.col(value)).alias(value), F.lit(k).alias("_part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where(F.length(value) > 0).groupBy(F.lower(value).alias("_low")).agg(F.min_by(value, F.struct("_part", value)).alias(value)).select(value)


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], deleted: Column) -> DataFrame:
    """base with rows of `changes` in place of those of the same key; changes that `deleted` marks remove the key."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.where(~F.coalesce(deleted, F.lit(False))).select(*base.columns))


def range_replaced(base: DataFrame, fresh: DataFrame, scope: DataFrame, key: str, number: str, low: str = "lo", high: str = "hi") -> DataFrame:
    """base with its rows whose number lies in their key's [lo, hi] replaced by fresh rows in that range; keys without a scope stay."""
    inside = F.col(low).isNotNull() & F.col(number).between(F.col(low), F.col(high))
    kept = base.join(scope, key, "left").where(~F.coalesce(inside, F.lit(False))).select(*base.columns)
    return kept.unionByName(fresh.join(scope, key).where(inside).select(*base.columns))


def patched(stored: Column, change: Column) -> Column:
    """A map with another's entries laid over it; nulls count as empty maps."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(stored, empty), F.coalesce(change, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def held_out(df: DataFrame, keys: list[str], order: list, every: int = 5, place: int = 2, name: str = "held_out") -> DataFrame:
    """Marks each key's rows at positions `place` modulo `every`."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(name, n % every == place)


def concatenated(parts: DataFrame, game: str, order: str, duration: str) -> DataFrame:
    """Adds `offset`: the summed durations of the parts of a game before each one."""
    w = Window.partitionBy(game).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(duration).over(w), F.lit(0)))


def dataset(parts: dict[str, DataFrame], key: str, label: str, remap: dict[str, dict[int, int]], fraction: float, seed: int) -> DataFrame:
    """One dataset of several: (key, label, source, split).

    Keys get their source as a prefix; labels are mapped by source, and those
    without a target go.  Each source is put into an order by the digest of key
    and seed; the last `fraction` of it is "val", all but at least one row.
    """
    out = None
    for source, df in parts.items():
        table = F.create_map(*[F.lit(x) for kv in remap[source].items() for x in kv])
        rows = df.select(F.concat(F.lit(source + "/"), F.col(key).cast("string")).alias(key), table[F.col(label)].alias(label), F.lit(source).alias("source")).where(F.col(label).isNotNull())
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy("source")
    place = F.row_number().over(w.orderBy(F.md5(F.concat(F.col(key), F.lit(str(seed)))), key))
    train = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * (1 - fraction)))
    return out.withColumn("split", F.when(place <= train, "train").otherwise("val"))


def rallies_overridden(given: DataFrame, games: DataFrame, game: str = "game", slack: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rallies, faults) of hand-made rallies (game, start_time_s, end_time_s).

    faults: (game, start_time_s, fault) of rallies that end before they begin,
    begin under 0, end more than `slack` after the game (game, fps, duration_s)
    or overlap the one before.  rallies: the games without a fault, numbered by
    start, with frames and durations computed anew.
    """
    w = Window.partitionBy(game).orderBy("start_time_s", "end_time_s")
    rows = given.join(games, game).withColumns({"rally_index": F.row_number().over(w) - 1, "_before": F.max("end_time_s").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    fault = F.when(F.col("end_time_s") <= F.col("start_time_s"), "ends before it begins").when(F.col("start_time_s") < 0, "begins before the game").when(F.col("end_time_s") > F.col("duration_s") + slack, "ends after the game").when(F.col("start_time_s") < F.col("_before"), "overlaps the one before")
    rows = rows.withColumn("fault", fault)
    faults = rows.where("fault is not null").select(game, "start_time_s", "fault")
    frame = lambda c: F.bround(F.col(c) * F.col("fps"), 0).cast("long")
    good = rows.join(faults.select(game).distinct(), game, "left_anti")
    return good.select(game, "rally_index", frame("start_time_s").alias("start_frame"), frame("end_time_s").alias("end_frame"), "start_time_s", "end_time_s", (F.col("end_time_s") - F.col("start_time_s")).alias("duration_s")), faults
