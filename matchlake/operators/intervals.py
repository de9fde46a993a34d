"""Interval operators.  Range conditions are joined by time buckets, so that they plan as equi joins with a residual."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def containing(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: int, pick: str | None = None) -> DataFrame:
    """Points joined to the closed ranges of their key that hold them; rows without one are dropped.

    bucket: a length of about a usual range.  pick: keep the one of the smallest `pick` per point (points must be distinct rows).
    """
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    out = p.join(r, [*keys, "_b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_b")
    if pick is None:
        return out
    best = Window.partitionBy(*points.columns).orderBy(pick)
    return out.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def merged(df: DataFrame, keys: list[str], start: str, end: str, before: float = 0, touch: float = 0) -> DataFrame:
    """Ranges of each key, begun `before` earlier but not under 0, joined where the next begins at most `touch` after the end so far."""
    rows = df.select(*keys, F.greatest(F.lit(0), F.col(start) - before).alias(start), F.col(end)).where(F.col(end) > F.col(start))
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) > reach + touch).cast("int"), F.lit(0))
    rows = rows.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of overlapping closed integer ranges of a key, with `overlap`, the number of shared points."""
    spread = lambda r: F.explode(F.sequence(F.floor(F.col(r[0]) / bucket), F.floor(F.col(r[1]) / bucket)))
    pairs = a.withColumn("_b", spread(a_range)).join(b.withColumn("_b", spread(b_range)), [*keys, "_b"])
    first = F.greatest(F.col(a_range[0]), F.col(b_range[0]))
    pairs = pairs.withColumn("overlap", F.least(F.col(a_range[1]), F.col(b_range[1])) - first + 1)
    return pairs.where((F.col("overlap") > 0) & (F.col("_b") == F.floor(first / bucket))).drop("_b")


def excess(df: DataFrame, keys: list[str], member: str, start: str, end: str, strength: str, most: int, slice_: int = 1 << 20, first: str | None = None) -> DataFrame:
    """(keys, member, excess): how long the half-open spans of each member are among the weakest beyond `most` active at once.

    Of equal strengths the smaller member is the weaker one; a member counts
    once, however many of its spans hold.  first: a column for the time at which
    a member is first beyond.  Spans are cut at multiples of slice_, and a
    sweep goes over the sorted begins and ends of each slice, with the `most`
    strongest apart from the rest: a logarithmic step for each, and in memory
    only what is active, so a long game is many tasks' work.  Empty spans and
    those with a null bound don't count.
    """
    item = [F.col(strength).alias("_s"), F.col(member).alias("_m")]
    cut = F.explode(F.sequence(F.floor(F.col(start) / slice_), F.ceil(F.col(end) / slice_) - 1))
    rows = df.where(F.col(end) > F.col(start)).select(*keys, *item, F.col(start).alias("_a"), F.col(end).alias("_e"), cut.alias("_cut"))
    ends = F.array(F.struct(F.greatest("_a", F.col("_cut") * slice_).alias("t"), F.lit(1).alias("d")), F.struct(F.least("_e", (F.col("_cut") + 1) * slice_).alias("t"), F.lit(0).alias("d")))
    events = rows.select(*keys, "_cut", "_s", "_m", F.explode(ends).alias("_x")).select(*keys, "_cut", F.col("_x.t").alias("_t"), F.col("_x.d").alias("_d"), "_s", "_m")
    events = events.repartition(*keys, "_cut").sortWithinPartitions(*keys, "_cut", "_t", "_d", "_s", "_m")
    kinds = events.schema
    out = StructType([*(kinds[k] for k in keys), StructField(member, kinds["_m"].dataType), StructField("excess", kinds["_t"].dataType), StructField("_since", kinds["_t"].dataType)])

    def sweep(batches):
        key, state = None, None
        for b in batches:
            names, made = [b.column(n).to_pylist() for n in (*keys, "_cut")], []
            for *at, t, d, s, m in zip(*names, *(b.column(n).to_pylist() for n in ("_t", "_d", "_s", "_m")), strict=True):
                if at != key or state is None:
                    key, state = at, Presence(most)
                made += [(*key[:-1], who, t - since, since) for who, since in state.step(t, d == 1, (s, m)) if t > since]
            columns = list(zip(*made, strict=True)) or [()] * len(out)
            arrow = [*(b.schema.field(k).type for k in keys), b.schema.field("_m").type, *[b.schema.field("_t").type] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, arrow, strict=True)], names=out.names)

    found = events.mapInArrow(sweep, out).groupBy(*keys, member)
    return found.agg(F.sum("excess").alias("excess"), *([F.min("_since").alias(first)] if first else []))


class Presence:
    """Who is active, the `most` strongest apart from the others."""

    def __init__(self, most: int):
        self.most, self.spans, self.since = most, {}, {}
        self.top, self.rest = [], []

    def step(self, t, begins: bool, item: tuple) -> list[tuple]:
        """Takes a begin or an end at t; (member, since) of all that stop being beyond the strongest."""
        held = self.spans.get(item, 0)
        self.spans[item] = held + (1 if begins else -1)
        if not self.spans[item]:
            del self.spans[item]
        if held > 1 or held and begins:
            return []
        if begins:
            insort(self.top, item)
            if len(self.top) > self.most:
                low = self.top.pop(0)
                insort(self.rest, low)
                self.since[low] = t
            return []
        k = bisect_left(self.top, item)
        if k == len(self.top) or self.top[k] != item:
            self.rest.pop(bisect_left(self.rest, item))
            return [(item[1], self.since.pop(item))]
        self.top.pop(k)
        if not self.rest:
            return []
        high = self.rest.pop()
        self.top.insert(0, high)
        return [(high[1], self.since.pop(high))]


def banded_pairs(df: DataFrame, keys: list[str], member: str, start: str, end: str, gap: int) -> DataFrame:
    """(keys, a, b): pairs of spans in order of start, the later beginning at most `gap` after the earlier ends."""
    return _banded(df, keys, member, start, end, gap, max(1, gap)).select(*keys, "a", "b")


def _banded(df: DataFrame, keys: list[str], member: str, start: str, end: str, gap: int, width: int) -> DataFrame:
    a = df.select(*keys, F.col(member).alias("a"), F.col(start).alias("_as"), F.col(end).alias("_ae"))
    b = df.select(*keys, F.col(member).alias("b"), F.col(start).alias("_bs"))
    a = a.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_as") / width), F.floor((F.col("_ae") + gap) / width))))
    b = b.withColumn("_k", F.floor(F.col("_bs") / width))
    later = (F.col("_bs") > F.col("_as")) | ((F.col("_bs") == F.col("_as")) & (F.col("b") > F.col("a")))
    return a.join(b, [*keys, "_k"]).where(later & (F.col("_bs") <= F.col("_ae") + gap))


def least_gaps(df: DataFrame, keys: list[str], member: str, start: str, end: str, gap: int, wide: int = 16) -> DataFrame:
    """(keys, a, b, gap): pairs of members, a the smaller, whose spans never overlap and come within `gap` of each other, with the least gap.

    Only spans of one bucket of `wide` gaps meet: those further apart can neither
    be the nearest nor overlap.  A wider bucket copies fewer spans into the next
    one and compares more.
    """
    near = _banded(df, keys, member, start, end, gap, max(1, wide * gap)).where("a <> b")
    pairs = near.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.agg(F.min(F.col("_bs") - F.col("_ae")).alias("gap")).where("gap > 0")


def inside_any(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: int, all_without: bool = False) -> DataFrame:
    """The points that some range of their key holds; with all_without also all points of keys that have no range."""
    r = ranges.select(*keys, start, end).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    same = lambda p, r: [p[k].eqNullSafe(r[k]) for k in keys]
    on = [*same(p, r), p["_b"] == r["_b"], p[at].between(r[start], r[end])]
    held = p.join(r, on, "left_semi").drop("_b")
    if not all_without:
        return held
    some = ranges.select(*keys).distinct()
    return held.unionByName(points.join(some, same(points, some), "left_anti"))


def rebased(df: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Ranges that lie wholly inside [low, high], counted from low."""
    return df.where((F.col(start) >= low) & (F.col(end) <= high)).withColumns({start: F.col(start) - low, end: F.col(end) - low})


def over_cap(df: DataFrame, keys: list[str], member: str, start: str, end: str, strength: str, most: int, share: float = 0.25) -> DataFrame:
    """(keys, member): spans that are beyond the `most` strongest for at least `share` of their own length."""
    life = df.groupBy(*keys, member).agg(F.sum(F.col(end) - F.col(start)).alias("_life"))
    return excess(df, keys, member, start, end, strength, most).join(life, [*keys, member]).where(F.col("excess") >= share * F.col("_life")).select(*keys, member)


def dense_rebased(df: DataFrame, keys: list[str], frame: str, fps: float, low: Column, high: Column) -> DataFrame:
    """Rows whose time frame / fps lies in [low, high], with `time` counted from low and frames renumbered from 0 without gaps."""
    time = F.col(frame) / fps
    kept = df.where(time.between(low, high)).withColumn("time", time - low)
    return kept.withColumn(frame, F.row_number().over(Window.partitionBy(*keys).orderBy(frame)) - 1)


def by_position(bounds: DataFrame, items: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Items at the positions start to end of their key's order, for each bound; an end beyond the last item is that, a start beyond it has none."""
    placed = items.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    open_ = bounds.join(counts, keys).where(F.col(start) < F.col("_n")).withColumn("position", F.explode(F.sequence(F.col(start).cast("int"), F.least(F.col(end), F.col("_n") - 1).cast("int"))))
    return open_.drop("_n").join(placed, [*keys, "position"])
