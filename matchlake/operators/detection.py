"""Detections of a ball and players: agreement, selection, hits, classes, identities' pair costs and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.operators.tables import saved
from matchlake.operators.vectors import _matrix

from matchlake.functions.scalars import angle, distance, iou, noisy_or, outside
from matchlake.params import Params

# Boxes that a size profile needs, its width in deviations; degrees of a block, place of the net.
PROFILE, WIDTH, BLOCK_TURN, NET = 30, 1.5, 120.0, 9.0


def agreed(candidates: DataFrame, keys: list[str], candidate: str, model: str, x: str, y: str, confidence: str, radius: float) -> DataFrame:
    """Adds `combined`: the confidence, raised by the highest one that another model gives near it in the same frame."""
    o = candidates.select(*keys, F.col(model).alias("_m"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(confidence).alias("_c"))
    near = candidates.join(o, keys).where((F.col("_m") != F.col(model)) & (distance(F.col(x), F.col(y), F.col("_x"), F.col("_y")) <= radius))
    best = near.groupBy(*keys, candidate).agg(F.max("_c").alias("_best"))
    out = candidates.join(best, [*keys, candidate], "left")
    return out.withColumn("combined", F.coalesce(noisy_or(F.col(confidence), F.col("_best")), F.col(confidence))).drop("_best")


def selected(candidates: DataFrame, game: str, frame: str, candidate: str, width: str, height: str, confidence: str, params: Params | None = None) -> DataFrame:
    """One candidate per frame in two passes: (game, frame, candidate), null where none is sure enough.

    First the surest of each frame; if a game has PROFILE of these, their sizes
    give plausible ranges, and then the candidate nearest to these is taken (of
    equals the surer, then the smaller id).
    """
    sure_at = (params or Params()).get("ball_detection", "MIN_SELECT_CONFIDENCE")
    w = Window.partitionBy(game, frame)
    rows = candidates.withColumn("_first", F.row_number().over(w.orderBy(F.desc(confidence), candidate)) == 1)
    sure = rows.where(F.col("_first") & (F.col(confidence) >= sure_at))
    m, s = (lambda c: F.avg(c)), (lambda c: F.stddev_pop(c))
    profile = sure.groupBy(game).agg(F.count("*").alias("_n"), m(width).alias("_mw"), s(width).alias("_sw"), m(height).alias("_mh"), s(height).alias("_sh")).where(F.col("_n") >= PROFILE)
    rows = rows.join(profile, game, "left")
    off = lambda v, a, b: outside(F.col(v), F.greatest(F.lit(0.0), F.col(a) - WIDTH * F.col(b)), F.col(a) + WIDTH * F.col(b))
    rows = rows.withColumn("_off", F.when(F.col("_n").isNotNull(), off(width, "_mw", "_sw") + off(height, "_mh", "_sh")).otherwise(0.0))
    best = rows.withColumn("_k", F.row_number().over(w.orderBy(F.round("_off", 9), F.desc(confidence), candidate))).where("_k = 1")
    return best.select(game, frame, F.when(F.col(confidence) >= sure_at, F.col(candidate)).alias(candidate))


def hits(points: DataFrame, keys: list[str], time: str, x: str, y: str, low: int = 5, high: int = 15, params: Params | None = None) -> DataFrame:
    """Points where the path turns or speeds up: (keys, time, turn, speed_in, speed_out), by neighbours low to high frames away."""
    w = Window.partitionBy(*keys).orderBy(time)
    pick = F.struct(time, x, y)
    rows = points.withColumn("_b", F.last(pick).over(w.rangeBetween(-high, -low))).withColumn("_a", F.first(pick).over(w.rangeBetween(low, high)))
    rows = rows.where("_b is not null and _a is not null")
    ux, uy, vx, vy = F.col(x) - F.col(f"_b.{x}"), F.col(y) - F.col(f"_b.{y}"), F.col(f"_a.{x}") - F.col(x), F.col(f"_a.{y}") - F.col(y)
    s_in = F.sqrt(ux * ux + uy * uy) / (F.col(time) - F.col(f"_b.{time}"))
    s_out = F.sqrt(vx * vx + vy * vy) / (F.col(f"_a.{time}") - F.col(time))
    rows = rows.select(*keys, time, angle(ux, uy, vx, vy).alias("turn"), s_in.alias("speed_in"), s_out.alias("speed_out"))
    ratio = F.when(F.col("speed_in") <= 1e-6, float("inf")).otherwise(F.greatest("speed_in", "speed_out") / F.when(F.col("speed_in") > 1e-6, F.col("speed_in")))
    p = params or Params()
    return rows.where((F.col("turn") >= p.get("action_detection", "HIT_ANGLE_THRESHOLD_DEG")) | (ratio >= p.get("action_detection", "HIT_SPEED_RATIO_THRESHOLD")))


def action_class(since_start: Column, serve_window: float, x: Column, turn: Column, speed_in: Column, speed_out: Column, previous_out: Column, params: Params | None = None) -> Column:
    """The first rule that holds: serve, block, spike, dig, set, else hit."""
    p = params or Params()
    near = F.coalesce(F.abs(x - NET) <= p.get("action_detection", "NET_PROXIMITY_M"), F.lit(False))
    return (
        F.when(since_start <= serve_window, "serve")
        .when(near & (turn >= BLOCK_TURN), "block")
        .when(near & (speed_out > speed_in), "spike")
        .when((previous_out >= p.get("action_detection", "FAST_INCOMING_SPEED_MS")) & (speed_out < previous_out), "dig")
        .when(speed_out < speed_in, "set")
        .otherwise("hit")
    )


def bridged(spans: DataFrame, pairs: DataFrame, keys: list[str], member: str, start: str, end: str, twice: DataFrame | None = None) -> DataFrame:
    """(keys, a, b, gap): the least gap between spans of two members; pairs with overlapping spans are dropped.

    twice: (keys, a, b) of pairs that are one body seen twice where they overlap, see seen_twice; their gap is 0.
    """
    a = spans.select(*keys, F.col(member).alias("a"), F.col(start).alias("_s1"), F.col(end).alias("_e1"))
    b = spans.select(*keys, F.col(member).alias("b"), F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    gap = F.greatest(F.col("_s1") - F.col("_e2"), F.col("_s2") - F.col("_e1"))
    out = pairs.join(a, [*keys, "a"]).join(b, [*keys, "b"]).groupBy(*keys, "a", "b").agg(F.min(gap).alias("gap"))
    if twice is None:
        return out.where("gap > 0")
    ordered = twice.select(*keys, F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"), F.lit(True).alias("_twice")).distinct()
    out = out.withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")}).join(ordered, [*keys, "_a", "_b"], "left")
    return out.where("gap > 0 or _twice").select(*keys, "a", "b", F.greatest("gap", F.lit(0)).alias("gap"))


def gaps(spans: DataFrame, keys: list[str], member: str, start: str, end: str, twice: DataFrame | None = None) -> DataFrame:
    """bridged() over all pairs a < b of the members of a key, found in one pass over a key's spans.

    A member's spans, sorted, with the latest end up to each, tell for any other
    span the nearest before and after it, so a pair of members costs a
    logarithmic step for each span instead of a product of spans.  No pair but a
    result leaves a task; a key (a game) is one task's work.
    """
    rows = spans.dropna(subset=[*keys, member, start, end]).select(*keys, F.col(member).alias("_m"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    if twice is not None:
        rows = rows.withColumn("_t", F.lit(None).cast(rows.schema["_m"].dataType))
        pairs = twice.select(*keys, F.least("a", "b").alias("_m"), F.lit(None).cast(rows.schema["_s"].dataType).alias("_s"), F.lit(None).cast(rows.schema["_e"].dataType).alias("_e"), F.greatest("a", "b").alias("_t"))
        rows = rows.unionByName(pairs)
    difference = rows.select((F.col("_s") - F.col("_e")).alias("gap")).schema["gap"].dataType
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(n, rows.schema["_m"].dataType) for n in ("a", "b")), T.StructField("gap", difference)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        key, known = table.slice(0, 1).select(keys), table
        also: dict = {}
        if "_t" in table.column_names:
            known = table.filter(pc.is_valid(table.column("_s")))
            told = table.filter(pc.is_null(table.column("_s")))
            for a, b in zip(told.column("_m").to_pylist(), told.column("_t").to_pylist(), strict=True):
                also.setdefault(a, set()).add(b)
        known = known.sort_by([("_m", "ascending"), ("_s", "ascending")])
        if not len(known):
            return
        names = known.column("_m").combine_chunks()
        s, e = (known.column(c).to_numpy() for c in ("_s", "_e"))
        codes = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        ids, bounds = names.take(pa.array(first)), [*first, len(codes)]
        listed = ids.to_pylist() if also else []
        place = {n: k for k, n in enumerate(listed)}
        for k in range(len(first) - 1):
            own, rest = slice(bounds[k], bounds[k + 1]), slice(bounds[k + 1], None)
            least = np.minimum.reduceat(_nearest(s[own], e[own], s[rest], e[rest]), first[k + 1 :] - bounds[k + 1])
            keep = least > 0
            if also:
                for n in also.get(listed[k], ()):
                    if n in place and place[n] > k:
                        keep[place[n] - k - 1] = True
            j = np.flatnonzero(keep)
            if len(j):
                columns = [*(key.column(c).take(pa.array(np.zeros(len(j), int))) for c in keys), ids.take(pa.array(np.full(len(j), k))), ids.take(pa.array(k + 1 + j)), pa.array(np.maximum(least[j], 0))]
                yield from pa.table(dict(zip(schema.names, columns, strict=True))).combine_chunks().to_batches()

    return rows.groupBy(*keys).applyInArrow(run, schema)


# Frames, share of the shorter track and mean overlap up to which two boxes of a frame are one body.
TWICE_FRAMES, TWICE_SHARE, TWICE_IOU = 30, 0.02, 0.40


def seen_twice(boxes: DataFrame, keys: list[str], member: str, frame: str, corners: tuple[str, str, str, str], cell: float, frames: int = TWICE_FRAMES, share: float = TWICE_SHARE, least: float = TWICE_IOU) -> DataFrame:
    """(keys, a, b, shared, overlap): members that a detector boxed twice, by the frames that both are in.

    These are few, in number and as a share of the shorter track's frames, and
    their boxes overlap by `least` on average.  Boxes (one per member and frame)
    meet only in the cells of a grid that both touch, `cell` wide and high, so
    boxes far from each other in a frame are never compared; frames are only
    counted for pairs whose boxes overlap somewhere.  Frames with a single box
    are left out first, by one shuffle; only the others' boxes are dealt to cells.
    """
    n = [F.col(c).cast("double") for c in corners]
    rows = boxes.select(*keys, F.col(member).alias("_m"), F.col(frame).alias("_f"), *[c.alias(f"_{k}") for k, c in enumerate(n)])
    crowded = rows.withColumn("_boxes", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_f"))).where("_boxes > 1").drop("_boxes")
    across = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    cells = crowded.withColumn("_cx", across("_0", "_2")).withColumn("_cy", across("_1", "_3"))
    other = cells.select(*keys, "_f", "_cx", "_cy", F.col("_m").alias("b"), *[F.col(f"_{k}").alias(f"_o{k}") for k in range(4)])
    met = cells.withColumnRenamed("_m", "a").join(other, [*keys, "_f", "_cx", "_cy"]).where("a < b")
    first = (F.col("_cx") == F.floor(F.greatest("_0", "_o0") / cell)) & (F.col("_cy") == F.floor(F.greatest("_1", "_o1") / cell))
    both = iou(tuple(F.col(f"_{k}") for k in range(4)), tuple(F.col(f"_o{k}") for k in range(4)))
    sums = met.where(first).groupBy(*keys, "a", "b").agg(F.sum(both).alias("_sum")).where("_sum > 0")
    times = rows.groupBy(*keys, "_m").agg(F.count("*").alias("_n"))
    of = lambda to, n: times.select(*keys, F.col("_m").alias(to), F.col("_n").alias(n))
    at = crowded.select(*keys, "_m", "_f")
    shared = sums.select(*keys, "a", "b").join(at.withColumnRenamed("_m", "a"), [*keys, "a"]).join(at.withColumnRenamed("_m", "b"), [*keys, "b", "_f"]).groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"))
    out = sums.join(shared, [*keys, "a", "b"]).join(of("a", "_na"), [*keys, "a"]).join(of("b", "_nb"), [*keys, "b"])
    few = (F.col("shared") <= frames) & (F.col("shared") <= share * F.least("_na", "_nb"))
    return out.where(few & (F.col("_sum") / F.col("shared") >= least)).select(*keys, "a", "b", "shared", (F.col("_sum") / F.col("shared")).alias("overlap"))


def pair_cost(gap: Column, metres: Column, zone: Column, appearance: Column, opposite: Column, calibrated: bool = True) -> Column:
    """Cost of taking two tracklets for one player; null if they can't be.

    opposite: the lesser of two side confidences where the sides differ, else
    null.  A near continuation in space and time costs next to nothing.
    Without calibration places say nothing: only look, time and side count.
    """
    penalty = F.when(opposite.isNotNull(), 0.35 * opposite).otherwise(0.0)
    if not calibrated:
        seen = F.when((gap <= 1800) & (appearance <= 0.22) & (F.coalesce(opposite, F.lit(0.0)) < 0.7), 0.85 * appearance + 0.15 * F.least(F.lit(1.0), gap / 1800.0) + penalty)
        return F.when(seen <= 0.45, seen)
    blend = 0.45 * appearance + 0.40 * zone + 0.15 * F.least(F.lit(1.0), gap / 1800.0) + penalty
    cost = F.when(gap > 1800, None).when((gap <= 15) & (metres <= 1.0), 0.05 * metres).when((zone > 0.85) | (appearance > 0.22), None).otherwise(blend)
    return F.when(F.coalesce(opposite, F.lit(0.0)) >= 0.7, None).when(cost <= 0.45, cost)


# Fixed value: frames after which places count half.
RELAXED = 25.0


def merge_cost(gap: Column, metres: Column, zone: Column, appearance: Column, moved: Column, side_a: Column, sure_a: Column, side_b: Column, sure_b: Column, most: float | None = None, params: Params | None = None) -> Column:
    """The whole cost of merging two clusters; null if they can't be one player or it is above `most`.

    gap: frames between their spans (null: they overlap); metres: the move
    across the court in it (null: not calibrated); zone and appearance:
    distances (null: unknown); moved: the move as a share of the diagonal;
    sides with their confidences.
    """
    p = params or Params()
    by_look, by_zone, look_alone, opposite, near_look, sure, bar = (p.get("player_tracking", n) for n in ("APPEARANCE_WEIGHT", "ZONE_WEIGHT", "APPEARANCE_WEIGHT_WITHOUT_ZONES", "SIDE_MISMATCH_PENALTY", "APPEARANCE_MAX_DISTANCE", "SIDE_MIN_CONFIDENCE", "MERGE_MAX_COST"))
    most = bar if most is None else most
    differ = F.coalesce(side_a != side_b, F.lit(False))
    penalty = F.when(differ, opposite * F.least(sure_a, sure_b)).otherwise(0.0)
    spatial = F.least(F.lit(1.0), moved / (1.0 + gap / RELAXED))
    blend = F.when(zone.isNull(), look_alone * appearance + (1 - look_alone) * spatial).otherwise(by_look * appearance + by_zone * zone + (1 - by_look - by_zone) * spatial) + penalty
    seen = F.when(~F.coalesce(zone > 0.85, F.lit(False)) & (appearance <= near_look) & (blend <= most), blend)
    cost = F.when((gap <= 15) & (metres <= 1.0), 0.05 * metres).otherwise(seen)
    return F.when((gap <= 1800) & ~(differ & (sure_a >= sure) & (sure_b >= sure)), cost)


def reselected(raw: DataFrame, roi: DataFrame, game: str, frame: str, candidate: str, width: str, height: str, confidence: str, x: str, y: str, least: float) -> DataFrame:
    """selected() over raw candidates under another region of interest (game, x1, y1, x2, y2) and least diagonal; games without a region keep all."""
    rows = raw.join(roi, game, "left")
    inside = F.col("x1").isNull() | (F.col(x).between(F.col("x1"), F.col("x2")) & F.col(y).between(F.col("y1"), F.col("y2")))
    kept = rows.where(inside & (F.sqrt(F.col(width) * F.col(width) + F.col(height) * F.col(height)) >= least))
    return selected(kept.select(*raw.columns), game, frame, candidate, width, height, confidence)


def candidate_matches(spans: DataFrame, places: DataFrame, gallery: DataFrame, keys: list[str], member: str, start: str, end: str, zone: str, side: str, vector: str, shape: str, zone_most: float = 0.95, confident: float | None = None, most: float | None = None, twice: DataFrame | None = None, params: Params | None = None) -> DataFrame:
    """(keys, a, b, distance): pairs of members that may be one player, of which no time, place, side or look speaks against.

    Their spans don't overlap (but for the pairs in twice, see bridged), their zones (shares of the rows of places) differ
    by at most zone_most, they are not on different sides with both at least
    `confident`, and the mean distance of their galleries is at most `most`.
    Unknown zones and sides speak against nothing; without vectors there is no match.
    A game's members are dealt to parts that meet two by two in a task, with
    their vectors; only matches leave it.
    """
    p = params or Params()
    confident = p.get("player_tracking", "SIDE_MIN_CONFIDENCE") if confident is None else confident
    most = p.get("player_tracking", "CANDIDATE_MAX_APPEARANCE_DISTANCE") if most is None else most
    each = places.where(F.col(zone).isNotNull()).groupBy(*keys, member, zone).agg(F.count("*").alias("_n"))
    zones = each.groupBy(*keys, member).agg(F.collect_list(F.struct(F.col(zone).alias("z"), F.col("_n").alias("n"))).alias("_zones"))
    sides = places.groupBy(*keys, member).agg(F.count_if(F.col(side) == "A").alias("_A"), F.count_if(F.col(side) == "B").alias("_B"))
    times = spans.dropna(subset=[*keys, member, start, end]).groupBy(*keys, member).agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias("_spans"))
    known = times.join(zones, [*keys, member], "left").join(sides, [*keys, member], "left")
    known = known.withColumns({"_a": F.when(F.col("_A") + F.col("_B") > 0, F.col("_A") >= F.col("_B")), "_sure": F.expr("try_divide(greatest(_A, _B), _A + _B)")})
    kind = times.schema[member].dataType
    if twice is None:
        known = known.withColumn("_twice", F.lit(None).cast(T.ArrayType(kind)))
    else:
        known = known.join(twice.groupBy(*keys, F.least("a", "b").alias(member)).agg(F.collect_set(F.greatest("a", "b")).alias("_twice")), [*keys, member], "left")
    known = saved(known.select(*keys, F.col(member).alias("_m"), "_spans", "_zones", "_a", "_sure", "_twice"))
    looks = gallery.where(F.col(vector).isNotNull()).select(*keys, F.col(member).alias("_m"), F.col(shape).cast("double").alias("_bin"), F.col(vector).alias("_v"))
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_ms")).join(looks.groupBy(*keys).agg(F.count("*").alias("_vs")), keys)
    many = F.broadcast(sizes.select(*keys, F.greatest(F.ceil(F.col("_ms") / SQUARE), F.ceil(F.col("_vs") / SQUARE_LOOKS)).alias("_n")).where("_n > 1"))

    def dealt(df: DataFrame) -> DataFrame:
        part = df.join(many, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_p", F.pmod(F.xxhash64("_m"), F.col("_n")))
        met = part.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        return met.withColumns({"_i": F.least("_p", "_o"), "_j": F.greatest("_p", "_o")}).drop("_n", "_o")

    schema = T.StructType([*(known.schema[k] for k in keys), T.StructField("a", kind), T.StructField("b", kind), T.StructField("distance", T.DoubleType())])

    def run(members: pa.Table, seen: pa.Table) -> pa.Table:
        return _matches(members, seen, keys, schema.names, zone_most, confident, most)

    on = [*keys, "_i", "_j"]
    return dealt(known).groupBy(*on).cogroup(dealt(looks).groupBy(*on)).applyInArrow(run, schema)


# Members and vectors of a part of a game; two parts meet in a task.
SQUARE, SQUARE_LOOKS = 256, 4096


def _matches(members: pa.Table, seen: pa.Table, keys: list[str], names: list[str], zone_most: float, confident: float, most: float) -> pa.Table:
    """The matches of a square: members of its first part with those of its second, or of its only one with each other."""
    types = [*(members.schema.field(k).type for k in keys), *[members.schema.field("_m").type] * 2, pa.float64()]
    none = pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
    ids = pc.unique(seen.column("_m"))
    members = members.filter(pc.is_in(members.column("_m"), value_set=ids)).sort_by("_m")
    if len(members) < 2:
        return none
    ids = members.column("_m").combine_chunks()
    at = pc.index_in(seen.column("_m"), value_set=ids)
    seen = seen.filter(pc.is_valid(at))
    owner, shape, vectors = pc.drop_null(at).to_numpy().astype(int), seen.column("_bin").to_numpy(), _matrix(seen.column("_v"))
    order = np.lexsort((shape, owner))
    owner, shape, vectors = owner[order], shape[order], vectors[order]
    inside = members.column("_i")[0] == members.column("_j")[0]
    here = pc.equal(members.column("_p"), members.column("_i")).to_numpy()
    left, right = (np.arange(len(ids)),) * 2 if inside else (np.flatnonzero(here), np.flatnonzero(~here))
    if not len(left) or not len(right):
        return none
    ok = _no_overlap(members, left, right) & _zones_meet(members, left, right, zone_most) & ~_opposite(members, left, right, confident)
    if inside:
        ok &= left[:, None] < right
    if not ok.any():
        return none
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (shape[1:] != shape[:-1])])
    n = np.diff(np.r_[first, len(owner)])
    mean = np.add.reduceat(vectors, first) / n[:, None]
    away = np.linalg.norm(vectors - np.repeat(mean, n, axis=0), axis=1)
    radius, length = np.maximum.reduceat(away, first), np.maximum.reduceat(np.linalg.norm(vectors, axis=1), first)
    norm, bins, whose = np.linalg.norm(mean, axis=1), shape[first], owner[first]
    x, y = (np.flatnonzero(np.isin(whose, side)) for side in (left, right))
    starts = [np.flatnonzero(np.r_[True, whose[k][1:] != whose[k][:-1]]) for k in (x, y)]
    fold = lambda f, m: f.reduceat(f.reduceat(m, starts[0], axis=0), starts[1], axis=1)
    inner, step = mean[x] @ mean[y].T, 0.2 * np.abs(bins[x][:, None] - bins[y]) / 3
    lowest = inner - norm[x][:, None] * radius[y] - radius[x][:, None] * norm[y] - radius[x][:, None] * radius[y]
    safe = fold(np.logical_and, (lowest >= -1 + 2 * step + 1e-9) & (length[x][:, None] * length[y] <= 1 + 1e-6))
    count = n[x][:, None] * n[y].astype(float)
    distance = fold(np.add, count * ((1 - inner) / 2 + step)) / fold(np.add, count)
    bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
    for i, j in np.argwhere(ok & ~safe):  # distances that are cut at 0 or 1: vector by vector
        p, q = (slice(bounds[k], bounds[k + 1]) for k in (left[i], right[j]))
        total = 0.0
        for lo in range(p.start, p.stop, 1024):
            o = slice(lo, min(lo + 1024, p.stop))
            total += np.minimum(1.0, np.clip((1 - vectors[o] @ vectors[q].T) / 2, 0.0, 1.0) + 0.2 * np.abs(shape[o][:, None] - shape[q]) / 3).sum()
        distance[i, j] = total / ((p.stop - p.start) * (q.stop - q.start))
    i, j = np.nonzero(ok & (distance <= most))
    one, two = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
    columns = [*(members.column(k).take(pa.array(np.zeros(len(i), int))) for k in keys), ids.take(pa.array(one)), ids.take(pa.array(two)), pa.array(distance[i, j])]
    return pa.table(dict(zip(names, columns, strict=True))).cast(pa.schema(list(zip(names, types, strict=True))))


def _no_overlap(members: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether spans of two members never overlap, or the members were seen twice."""
    spans = members.column("_spans").combine_chunks()
    flat, of = spans.flatten(), np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy())
    s, e = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    if len(of) == len(spans):
        ok = np.maximum(s[left][:, None] - e[right], s[right] - e[left][:, None]) > 0
    else:
        bounds, held = np.searchsorted(of, np.arange(len(spans) + 1)), np.isin(of, right)
        first = np.flatnonzero(np.r_[True, of[held][1:] != of[held][:-1]])
        ok = np.array([np.minimum.reduceat(_nearest(s[bounds[k] : bounds[k + 1]], e[bounds[k] : bounds[k + 1]], s[held], e[held]), first) > 0 for k in left])
    place = {}
    for k, also in enumerate(members.column("_twice").to_pylist()):
        if also:
            place = place or {m: n for n, m in enumerate(members.column("_m").to_pylist())}
            for m in also:
                for p, q in ((k, place.get(m)), (place.get(m), k)):
                    ok[np.ix_(left == p, right == q)] = True
    return ok


def _nearest(starts: np.ndarray, ends: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For each span (s, e) the least gap to spans sorted by their starts; not above 0 where one overlaps."""
    latest, at = np.maximum.accumulate(ends), np.searchsorted(starts, e, "right")
    before, after = s - latest[np.maximum(at - 1, 0)], starts[np.minimum(at, len(starts) - 1)] - e
    return np.where(at == 0, after, np.where(at == len(starts), before, np.minimum(before, after)))


def _zones_meet(members: pa.Table, left: np.ndarray, right: np.ndarray, most: float) -> np.ndarray:
    """Whether the shares of zones differ by at most `most`; unknown zones do."""
    share, known = {}, np.zeros(len(members), bool)
    for k, zones in enumerate(members.column("_zones").to_pylist()):
        whole = sum(z["n"] for z in zones or ())
        known[k] = whole > 0
        for z in zones or ():
            share.setdefault(z["z"], np.zeros(len(members)))[k] = z["n"] / whole
    both = np.zeros((len(left), len(right)))
    for z in sorted(share):
        both += np.minimum(share[z][left][:, None], share[z][right])
    return (1 - both <= most) | ~known[left][:, None] | ~known[right]


def _opposite(members: pa.Table, left: np.ndarray, right: np.ndarray, confident: float) -> np.ndarray:
    """Whether both sides are surely known and differ."""
    told = pc.fill_null(members.column("_a"), False).to_numpy()
    sure = pc.fill_null(members.column("_sure"), -1.0).to_numpy() >= confident
    sure &= pc.is_valid(members.column("_a")).to_numpy()
    return (told[left][:, None] != told[right]) & sure[left][:, None] & sure[right]


def set_sides(samples: DataFrame, keys: list[str], side: str, team: str, weight: str, least: int = 1) -> DataFrame:
    """(keys, A, B): which team, x or y, holds each side by weighted votes.

    Equal votes go to y; a side under `least` is open; the same team on both
    sides leaves both open; a single known side settles the other.
    """
    v = lambda s, t: F.coalesce(F.sum(F.when((F.col(side) == s) & (F.col(team) == t), F.col(weight))), F.lit(0))
    votes = samples.groupBy(*keys).agg(*[v(s, t).alias(f"_{s}{t}") for s in "AB" for t in "xy"])
    said = {s: F.when(F.greatest(f"_{s}x", f"_{s}y") >= least, F.when(F.col(f"_{s}x") > F.col(f"_{s}y"), "x").otherwise("y")) for s in "AB"}
    rows = votes.withColumns({f"_{s}": said[s] for s in "AB"})
    same = F.coalesce(F.col("_A") == F.col("_B"), F.lit(False))
    other = lambda c: F.when(c == "x", "y").when(c == "y", "x")
    return rows.select(*keys, F.when(~same, F.coalesce("_A", other(F.col("_B")))).alias("A"), F.when(~same, F.coalesce("_B", other(F.col("_A")))).alias("B"))


def truth_metrics(df: DataFrame, keys: list[str], visible: Column, found: Column, error: Column, tolerance: float) -> DataFrame:
    """Counts of correct, wrong and missed visible frames, of false and right absences, recall, and error figures by sorted index."""
    e = F.when(visible & found, error)
    out = df.groupBy(*keys).agg(
        F.count_if(visible & found & (error <= tolerance)).alias("correct"),
        F.count_if(visible & found & (error > tolerance)).alias("wrong"),
        F.count_if(visible & ~found).alias("missed"),
        F.count_if(~visible & found).alias("false_positive"),
        F.count_if(~visible & ~found).alias("absent"),
        F.avg(e).alias("mean_error"),
        F.sort_array(F.collect_list(e)).alias("_e"),
    )
    at = lambda k: F.when(F.size("_e") > 0, F.element_at("_e", (k + 1).cast("int")))
    n = F.size("_e")
    return out.withColumns({"recall": F.expr("try_divide(correct, correct + wrong + missed)"), "median_error": at(F.floor(n / 2)), "p90_error": at(F.floor(n * 0.9))}).drop("_e")


def plausible_person(x1: Column, y1: Column, x2: Column, y2: Column, frame_w: Column, frame_h: Column) -> Column:
    """Height to width between 0.9 and 4.5, and not within a hundredth of the frame's edge where its size is known."""
    shape = (y2 - y1) / F.when(x2 > x1, x2 - x1)
    inside = (x1 > 0.01 * frame_w) & (x2 < 0.99 * frame_w) & (y1 > 0.01 * frame_h) & (y2 < 0.99 * frame_h)
    return F.coalesce(shape.between(0.9, 4.5), F.lit(False)) & F.coalesce(inside, F.lit(True))


def grouped_touches(touches: DataFrame, mapping: DataFrame, ignored: DataFrame, game: str, player: str) -> DataFrame:
    """Touches with players replaced by their canonical ones; those of ignored players, before or after, go; touches without a player stay."""
    m = mapping.select(game, F.col("id").alias(player), F.col("canonical").alias("_c"))
    i = ignored.select(game, F.col("id").alias(player)).distinct()
    known = touches.where(F.col(player).isNotNull()).join(i, [game, player], "left_anti").join(m, [game, player], "left").withColumn(player, F.coalesce("_c", player)).drop("_c")
    known = known.join(i, [game, player], "left_anti").select(*touches.columns)
    return known.unionByName(touches.where(F.col(player).isNull()))
