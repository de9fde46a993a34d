"""Ordered operators: neighbours, sessions, runs, smoothing, folds and gap filling.

Each is partitioned by keys and needs a total order; none collects more than a
key's own rows, and only `fold`-based ones hold a key's rows at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.params import Params


def over(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def neighbours(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Adds prev_ and next_ of each column. Null keys form one partition."""
    w = over(keys, order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {f"next_{c}": F.lead(c).over(w) for c in columns})


def sessions(df: DataFrame, keys: list[str], order: list, time: Column, gap, name: str = "session") -> DataFrame:
    """Numbers sessions from 0: a new one begins where the time is more than `gap` after the row before."""
    w = over(keys, order)
    new = F.coalesce((time - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands(df: DataFrame, keys: list[str], order: list, label: Column, name: str = "island") -> DataFrame:
    """Numbers maximal runs of rows with the same label, from 0 (nulls are one label)."""
    w = over(keys, order)
    new = (~F.lag(label).over(w).eqNullSafe(label) & (F.row_number().over(w) > 1)).cast("int")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def majority(df: DataFrame, keys: list[str], order: list, label: str, labels: list[str], reach: int = 2, name: str = "smoothed") -> DataFrame:
    """The most frequent label among the rows up to `reach` before and after; of equals the one that comes first in the window."""
    w = over(keys, order).rowsBetween(-reach, reach)
    seen = F.collect_list(label).over(w)
    ranked = F.array_sort(F.transform(F.array(*map(F.lit, labels)), lambda x: F.struct((-F.size(F.filter(F.col("_seen"), lambda y: y == x))).alias("n"), F.when(F.array_position("_seen", x) > 0, F.array_position("_seen", x)).otherwise(1 << 30).alias("at"), x.alias("label"))))
    return df.withColumn("_seen", seen).withColumn(name, ranked[0]["label"]).drop("_seen")


def live_rallies(chunks: DataFrame, keys: list[str], chunk: str, label: str, labels: list[str], live: list[str], fps: float, stride: int, frames: str, params: Params | None = None) -> DataFrame:
    """(keys, rally, start_frame, end_frame, duration): rallies of a film whose chunks of `stride` frames have labels.

    Chunks are numbered from 0.  Labels are smoothed by the majority of a
    window; chunks of the labels `live` make a rally while no more than a gap
    lies between two of them, and short rallies are left out, the others
    numbered from 0.  Window, gap and shortest rally are parameters of
    game_status, in seconds, and count one chunk at least.  frames: the column
    with the film's number of frames, at which its last chunk ends.
    """
    p = params or Params()
    in_chunks = lambda name: max(1, round(p.get("game_status", name) * fps / stride))
    smooth = majority(chunks, keys, [chunk], label, labels, p.get("game_status", "SMOOTHING_WINDOW_CHUNKS") // 2, "_label").where(F.col("_label").isin(*live))
    runs = sessions(smooth, keys, [chunk], F.col(chunk), in_chunks("MAX_GAP_SECONDS_WITHIN_RALLY"), "_run").groupBy(*keys, "_run").agg(F.min(chunk).alias("_a"), F.max(chunk).alias("_z"), F.max(frames).alias("_frames"))
    long = runs.where(F.col("_z") - F.col("_a") + 1 >= in_chunks("MIN_RALLY_DURATION_SECONDS"))
    begin, end = F.col("_a") * stride, F.least((F.col("_z") + 1) * stride, F.col("_frames")) - 1
    number = (F.row_number().over(over(keys, ["_a"])) - 1).cast("long")
    return long.select(*keys, number.alias("rally"), begin.alias("start_frame"), end.alias("end_frame"), ((end - begin) / fps).alias("duration"))


def separated(df: DataFrame, keys: list[str], time: str, strength: str, gap: float) -> DataFrame:
    """Greedy de-duplication: (keys, time, strength) of the kept rows.

    A row further than `gap` from the last kept one is kept; a nearer one takes
    its place if it is stronger (null is 0).  Rows without a time are left out.
    Where two neighbours are further apart than `gap`, what follows doesn't
    depend on what was before: a key is cut there into islands, which are dealt
    out and folded in order, holding the last kept row only.
    """
    w = Window.partitionBy(*keys).orderBy("_t", "_s")
    rows = df.select(*keys, F.col(time).cast("double").alias("_t"), F.col(strength).cast("double").alias("_s")).where("_t is not null")
    new = F.coalesce(F.col("_t") - F.lag("_t").over(w) > gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    names = [*keys, "_island"]
    rows = rows.repartition(*names).sortWithinPartitions(*names, F.col("_t"), F.col("_s").asc_nulls_first())
    out = T.StructType([*(rows.schema[k] for k in keys), T.StructField(time, T.DoubleType()), T.StructField(strength, T.DoubleType())])

    def fold(batches):
        key, last = None, None
        for b in batches:
            made = []
            for *at, t, s in zip(*(b.column(n).to_pylist() for n in (*names, "_t", "_s")), strict=True):
                if last is None or at != key or t - last[0] > gap:
                    if last is not None:
                        made.append((*key[:-1], *last))
                    key, last = at, (t, s)
                elif (s or 0.0) > (last[1] or 0.0):
                    last = (t, s)
            kinds = [*(b.schema.field(k).type for k in keys), pa.float64(), pa.float64()]
            yield _batch(made, kinds, out)
        if last is not None:
            yield _batch([(*key[:-1], *last)], kinds, out)

    return rows.mapInArrow(fold, out)


def _batch(rows: list[tuple], kinds: list, schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)


def dense_cells(df: DataFrame, keys: list[str], time: str, count: int = 10, span: int = 15) -> DataFrame:
    """The keys that have at least `count` distinct times inside some span of fewer than `span`."""
    times = df.select(*keys, time).distinct()
    w = Window.partitionBy(*keys).orderBy(time)
    far = F.lead(time, count - 1).over(w)
    return times.withColumn("_far", far).where(F.col("_far") - F.col(time) < span).select(*keys).distinct()


def running_differential(df: DataFrame, keys: list[str], order: list, plus: Column, minus: Column, name: str = "momentum") -> DataFrame:
    """Cumulative +1 where `plus`, -1 where `minus`."""
    step = F.when(plus, 1).when(minus, -1).otherwise(0)
    return df.withColumn(name, F.sum(step).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def gap_neighbour(df: DataFrame, keys: list[str], time: str, columns: list[str], low: int = 5, high: int = 15) -> DataFrame:
    """Adds before_ and after_ of each column: the nearest row whose time differs by low to high."""
    w = Window.partitionBy(*keys).orderBy(time)
    back, ahead = w.rangeBetween(-high, -low), w.rangeBetween(low, high)
    pick = F.struct(F.col(time), *[F.col(c) for c in columns if c != time])
    out = df.withColumn("_b", F.last(pick).over(back)).withColumn("_a", F.first(pick).over(ahead))
    return out.withColumns({f"before_{c}": F.col(f"_b.{c}") for c in [time, *columns] if c} | {f"after_{c}": F.col(f"_a.{c}") for c in [time, *columns]}).drop("_b", "_a")


def segments(df: DataFrame, keys: list[str], start: str, total: Column) -> DataFrame:
    """Breakpoints as closed segments: each ends one before the next starts, the last at `total`."""
    w = Window.partitionBy(*keys).orderBy(start)
    return df.withColumn("end", F.coalesce(F.lead(start).over(w) - 1, total))


def interpolated(df: DataFrame, keys: list[str], time: str, value: str, most: int) -> DataFrame:
    """Fills null values between two known ones at most `most` missing rows apart by a straight line; adds `interpolated`."""
    w = Window.partitionBy(*keys).orderBy(time)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    out = df.withColumn("_k", known)
    out = out.withColumn("_p", F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first("_k", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.col(value).isNull() & F.col("_p").isNotNull() & F.col("_n").isNotNull() & (F.col("_n.t") - F.col("_p.t") - 1 <= most)
    share = (F.col(time) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    line = F.col("_p.v") + share * (F.col("_n.v") - F.col("_p.v"))
    return out.withColumn("interpolated", near).withColumn(value, F.when(near, line).otherwise(F.col(value))).drop("_k", "_p", "_n")


def hermite(p0: Column, p1: Column, m0: Column, m1: Column, s: Column) -> Column:
    """Cubic Hermite value at share s of a span, m0 and m1 being the tangents times the span."""
    s2, s3 = s * s, s * s * s
    return (2 * s3 - 3 * s2 + 1) * p0 + (s3 - 2 * s2 + s) * m0 + (-2 * s3 + 3 * s2) * p1 + (s3 - s2) * m1


def hermite_filled(df: DataFrame, keys: list[str], time: str, value: str, most: int = 20, damping: float = 0.6) -> DataFrame:
    """Fills gaps of at most `most` rows by cubics whose tangents are the damped slopes of the known rows on either side.

    The slope at a gap's left end is that towards the known row before it, at its right end towards the one after; 0 without one.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_t"), F.col(value).cast("double").alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t")
    slope_in = F.coalesce((F.col("_v") - F.lag("_v").over(w)) / (F.col("_t") - F.lag("_t").over(w)), F.lit(0.0))
    after_t, after_v = F.lead("_t").over(w), F.lead("_v").over(w)
    slope_out = F.coalesce((F.lead("_v", 2).over(w) - after_v) / (F.lead("_t", 2).over(w) - after_t), F.lit(0.0))
    gaps = known.withColumns({"_in": slope_in, "_t1": after_t, "_v1": after_v, "_out": slope_out}).where((F.col("_t1") - F.col("_t") > 1) & (F.col("_t1") - F.col("_t") - 1 <= most))
    filled = gaps.withColumn(time, F.explode(F.sequence(F.col("_t") + 1, F.col("_t1") - 1)))
    span = F.col("_t1") - F.col("_t")
    curve = hermite(F.col("_v"), F.col("_v1"), F.col("_in") * damping * span, F.col("_out") * damping * span, (F.col(time) - F.col("_t")) / span)
    return known.select(*keys, F.col("_t").alias(time), F.col("_v").alias(value), F.lit(False).alias("interpolated")).unionByName(filled.select(*keys, time, curve.alias(value), F.lit(True).alias("interpolated")))


def renumbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Row numbers from 0 in each key."""
    return df.withColumn(name, F.row_number().over(over(keys, order)) - 1)


def every_kth(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """Every k-th row of each key by position, from the first."""
    return df.withColumn("_n", F.row_number().over(over(keys, order)) - 1).where(F.col("_n") % k == 0).drop("_n")


def evenly_spaced(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """k rows of each key at evenly spaced positions from first to last (all if fewer)."""
    w, whole = over(keys, order), Window.partitionBy(*keys)
    rows = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_c", F.count(F.lit(1)).over(whole))
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_c") - 1) / F.lit(max(1, k - 1)), 0).cast("long"))
    return rows.where((F.col("_c") <= k) | F.array_contains(spots, F.col("_n").cast("long"))).drop("_n", "_c")


def set_numbers(df: DataFrame, keys: list[str], order: list, split_after: Column, name: str = "set_index") -> DataFrame:
    """Numbers sets from 0: a set ends after each row that splits."""
    w = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(split_after.cast("int")).over(w), F.lit(0)))


def alternation(df: DataFrame, keys: list[str], number: str, value: str, other: dict[str, str]) -> DataFrame:
    """Fills null values from the lowest-numbered known one: the same at even distances, the other at odd ones."""
    w = Window.partitionBy(*keys)
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(number).alias("n"), F.col(value).alias("v")))).over(w)
    flip = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])
    guess = F.when(F.abs(F.col(number) - F.col("_f.n")) % 2 == 0, F.col("_f.v")).otherwise(flip[F.col("_f.v")])
    return df.withColumn("_f", first).withColumn(value, F.coalesce(F.col(value), guess)).drop("_f")
