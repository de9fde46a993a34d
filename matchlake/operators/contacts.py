"""Contacts of ball and player between two flights, and drawn arcs, from least-squares fits as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalars import distance
from matchlake.operators import asof, intervals, stats
from matchlake.params import Params

# m/s^2; points of a flight; seconds beyond the points and between two tries; metres and share of the diagonal that flights may miss each other by.
GRAVITY, LEAST, MARGIN, STEP, MISS, MISS_SHARE = 9.81, 4, 0.05, 1 / 240, 1.0, 0.05
# Share of the diagonal and frames that a player may be away; seconds of flight looked at.
REACH_SHARE, NEAR, LOOK = 0.15, 5, 3.0
# Points and seconds of an arc, share of the rise at which it is cut, mean error as a share of the diagonal.
ARC_POINTS, ARC_SECONDS, RISE, ERROR = 5, 0.15, 0.5, 0.01


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def flight_bounds(hits: DataFrame, keys: list[str], frame: str, rally: str, start: str, end: str, look: float) -> DataFrame:
    """Adds `low` and `high`: the hits before and after it in its rally, else the rally's ends, else `look` frames away; never further than that."""
    w = Window.partitionBy(*keys).orderBy(frame)
    edge = lambda other, bound, far: F.when(F.col(f"{other}_f").isNotNull() & F.col(f"{other}_r").eqNullSafe(F.col(rally)), F.col(f"{other}_f")).otherwise(F.coalesce(bound, far))
    rows = hits.withColumns({"_p_f": F.lag(frame).over(w), "_p_r": F.lag(rally).over(w), "_n_f": F.lead(frame).over(w), "_n_r": F.lead(rally).over(w)})
    first, last = F.col(frame) - look, F.col(frame) + look
    rows = rows.withColumns({"low": F.greatest(edge("_p", F.col(start), first), first), "high": F.least(edge("_n", F.col(end), last), last)})
    return rows.drop("_p_f", "_p_r", "_n_f", "_n_r")


def refined(hits: DataFrame, points: DataFrame, players: DataFrame, keys: list[str], fps: float, diagonal: float, near: int = NEAR, look: float = LOOK, params: Params | None = None) -> DataFrame:
    """hits with contacts moved to where the flights before and after meet: adds refined, at_px, at_py, at_cx, at_cy, at_height, at_time, speed_in, speed_out and real_units.

    hits: keys, frame, low, high (see flight_bounds), px, py.  points: keys,
    frame, px, py and, where known, cx, cy (court metres) and height; measured
    ones only, one per frame.  players: keys, frame, and places x, y in metres
    or px, py.  Flights are straight in the plane and fall with gravity; court
    metres are used where all points of both flights have them, else pixels.
    The gap of two straight flights is convex in time, so the best moment of
    the grid is one of the two beside its minimum and no grid is built.  Hits
    without enough points, whose flights miss each other, with no player near
    or with an impossible speed stay as they are, with null in the new columns.
    params: the reach of a player and the largest speed.
    """
    p = params or Params()
    reach, top_speed = p.get("action_detection", "MAX_PLAYER_ATTRIBUTION_DISTANCE_M"), p.get("ball_detection", "MAX_PLAUSIBLE_REPORTED_SPEED_MS")
    h = hits.select(*keys, F.col("frame").alias("_hit"), "low", "high").distinct()
    p = points.select(*keys, F.col("frame").alias("_f"), "px", "py", "cx", "cy", "height")
    span = max(1, int(look * fps))
    near_points = intervals.containing(p, h, keys, "_f", "low", "high", span).withColumn("_t", (F.col("_f") - F.col("_hit")) / fps)
    sides = {"i": F.col("_f") <= F.col("_hit"), "o": F.col("_f") >= F.col("_hit")}
    figures = []
    for s, side in sides.items():
        figures += [F.count_if(side).alias(f"n_{s}"), F.count_if(side & F.col("cx").isNotNull() & F.col("cy").isNotNull()).alias(f"c_{s}"), F.count_if(side & F.col("height").isNotNull()).alias(f"z_{s}")]
        for v in ("px", "py", "cx", "cy"):
            y = F.when(side, F.col(v))
            figures += [F.regr_intercept(y, "_t").alias(f"{v}_{s}"), F.regr_slope(y, "_t").alias(f"v{v}_{s}")]
        z = F.when(side, F.col("height") + 0.5 * GRAVITY * F.col("_t") * F.col("_t"))
        figures += [F.regr_intercept(z, "_t").alias(f"h_{s}"), F.regr_slope(z, "_t").alias(f"vh_{s}")]
    figures += [F.max(F.when(sides["i"], F.col("_t"))).alias("_last"), F.min(F.when(sides["o"], F.col("_t"))).alias("_first")]
    fit = near_points.groupBy(*keys, "_hit").agg(*figures).where(f"n_i >= {LEAST} and n_o >= {LEAST}")
    fit = fit.withColumn("_court", (F.col("c_i") == F.col("n_i")) & (F.col("c_o") == F.col("n_o")))
    pick = lambda v, s: F.when(F.col("_court"), F.col(f"{v.format('c')}_{s}")).otherwise(F.col(f"{v.format('p')}_{s}"))
    diff = lambda v: pick(v, "i") - pick(v, "o")
    low, high = F.least("_last", "_first") - MARGIN, F.greatest("_last", "_first") + MARGIN
    given = F.struct(diff("{}x").alias("dx"), diff("{}y").alias("dy"), diff("v{}x").alias("ex"), diff("v{}y").alias("ey"), low.alias("lo"), F.ceil((F.greatest(high, low + STEP) - low) / STEP).alias("n"))

    def best(g: Column) -> Column:
        """The moment of the grid at which the flights are nearest."""
        square = g["ex"] * g["ex"] + g["ey"] * g["ey"]
        least = F.when(square > 0, -(g["dx"] * g["ex"] + g["dy"] * g["ey"]) / square).otherwise(g["lo"])
        held = lambda k: F.greatest(F.lit(0), F.least(g["n"] - 1, k))
        at = lambda k: g["lo"] + k * STEP
        first = lambda k: F.when(miss(g, at(k)) <= miss(g, at(held(k + 1))), at(k)).otherwise(at(held(k + 1)))
        return _let(held(F.floor((least - g["lo"]) / STEP)), first)

    def miss(g: Column, t: Column) -> Column:
        return F.sqrt(F.pow(g["dx"] + g["ex"] * t, 2) + F.pow(g["dy"] + g["ey"] * t, 2))

    tall = lambda s: F.col("_court") & (F.col(f"z_{s}") >= LEAST)

    def contact(g: Column, t: Column) -> Column:
        middle = lambda v: (F.col(f"{v}_i") + F.col(f"v{v}_i") * t + F.col(f"{v}_o") + F.col(f"v{v}_o") * t) / 2
        fall = lambda s: F.when(tall(s), F.pow(F.col(f"vh_{s}") - GRAVITY * t, 2)).otherwise(0.0)
        speed = lambda s: F.sqrt(F.pow(pick("v{}x", s), 2) + F.pow(pick("v{}y", s), 2) + fall(s))
        made = {"at_px": middle("px"), "at_py": middle("py"), "at_cx": F.when(F.col("_court"), middle("cx")), "at_cy": F.when(F.col("_court"), middle("cy")), "at_height": F.when(tall("i") & tall("o"), middle("h") - 0.5 * GRAVITY * t * t), "at_time": F.col("_hit") / fps + t, "speed_in": speed("i"), "speed_out": speed("o"), "real_units": F.col("_court"), "miss": miss(g, t)}
        return F.struct(*[c.alias(n) for n, c in made.items()])

    made = ["at_px", "at_py", "at_cx", "at_cy", "at_height", "at_time", "speed_in", "speed_out", "real_units"]
    fit = fit.select(*keys, F.col("_hit").alias("frame"), F.inline(F.array(_let(given, lambda g: _let(best(g), lambda t: contact(g, t))))))
    fit = fit.where((F.col("miss") <= F.when(F.col("real_units"), MISS).otherwise(MISS_SHARE * diagonal)) & (~F.col("real_units") | ((F.col("speed_in") <= top_speed) & (F.col("speed_out") <= top_speed))))
    frames = players.select(*keys, F.col("frame").alias("_f")).distinct()
    seen = asof.nearest(fit, frames, keys, "frame", "_f", [], within=near, prefix="_p")
    r = players.select(*keys, F.col("frame").alias("_ptime"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("px").alias("_px"), F.col("py").alias("_py"))
    metres = distance(F.col("at_cx"), F.col("at_cy"), F.col("_x"), F.col("_y"))
    close = F.when(metres.isNotNull(), metres <= reach).otherwise(distance(F.col("at_px"), F.col("at_py"), F.col("_px"), F.col("_py")) / diagonal <= REACH_SHARE)
    good = seen.join(r, [*keys, "_ptime"]).where(close).select(*keys, "frame", *made).distinct()
    return hits.join(good.withColumn("refined", F.lit(True)), [*keys, "frame"], "left").withColumn("refined", F.coalesce("refined", F.lit(False)))


def arcs(points: DataFrame, keys: list[str], t: str, x: str, y: str, diagonal: float) -> DataFrame:
    """(keys, ax, bx, cx, ay, by, cy, begin, finish): parabolas of drawn flights, cut half way up on either side of the top.

    v = a t^2 + b t + c; y grows downwards.  Flights of too few points or too
    short, and those whose points within the cut are off by more than ERROR of
    the diagonal on average (from three points on), are left out.
    """
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = p.groupBy(*keys).agg(F.min(t).alias("_s"), F.max(t).alias("_e"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= ARC_POINTS) & (F.col("_e") - F.col("_s") >= ARC_SECONDS))
    fit = lambda v, n: stats.fit_parabola(p, keys, t, v).select(*keys, *[F.col(c).alias(c + n) for c in "abc"])
    rows = ends.join(fit(x, "x"), keys).join(fit(y, "y"), keys).where("ax is not null and ay is not null")
    a, b, c = F.col("ay"), F.col("by"), F.col("cy")
    value = lambda s: a * s * s + b * s + c
    rows = rows.withColumn("_top", F.when(a > 0, F.least(F.col("_e"), F.greatest(F.col("_s"), -b / (2 * a)))))

    def cut(end: str, sign: int) -> Column:
        target = value(F.col(end)) - RISE * (value(F.col(end)) - value(F.col("_top")))
        inner = b * b - 4 * a * (c - target)
        return F.when(inner >= 0, (-b + sign * F.sqrt(F.greatest(inner, F.lit(0.0)))) / (2 * a))

    first, last = F.coalesce(F.least(F.greatest(cut("_s", -1), F.col("_s")), F.col("_top")), F.col("_s")), F.coalesce(F.greatest(F.least(cut("_e", 1), F.col("_e")), F.col("_top")), F.col("_e"))
    rows = rows.withColumns({"_b": F.when(a > 0, first).otherwise(F.col("_s")), "_f": F.when(a > 0, last).otherwise(F.col("_e"))})
    rows = rows.withColumns({"begin": F.when(F.col("_f") > F.col("_b"), F.col("_b")).otherwise(F.col("_s")), "finish": F.when(F.col("_f") > F.col("_b"), F.col("_f")).otherwise(F.col("_e"))})
    s = F.col(t)
    off = distance(F.col(x), F.col(y), F.col("ax") * s * s + F.col("bx") * s + F.col("cx"), value(s))
    error = p.join(rows, keys).where(s.between(F.col("begin"), F.col("finish"))).groupBy(*keys).agg(F.avg(off).alias("_error"), F.count(F.lit(1)).alias("_shown"))
    out = rows.join(error, keys, "left").where(~F.coalesce((F.col("_shown") >= 3) & (F.col("_error") > ERROR * diagonal), F.lit(False)))
    return out.select(*keys, "ax", "bx", "cx", "ay", "by", "cy", "begin", "finish")
