"""Quality scores of touches by category, from columns of one wide row per touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalars import clamp01, distance, weighted_score
from matchlake.params import Params

# What a factor of 0 or 1 stands for, in metres, seconds and metres per second.
NET_X = 9.0
SERVE_SPEED, SERVE_PLACEMENT, SERVE_HEIGHT = 20.0, 3.0, 3.5
RECEIVE_PLACEMENT, RECEIVE_EXCESS, RECEIVE_SPEED = 2.5, 0.4, 8.0
SET_PLACEMENT, SET_HEIGHT, SET_HEIGHT_TOLERANCE, SET_TIME = 2.5, 3.0, 2.0, 1.5
SPIKE_POSITION, SPIKE_SPEED, SPIKE_PLACEMENT, SPIKE_BLOCKERS, BLOCKER_REACH = 3.0, 22.0, 3.0, 2, 1.5
BLOCK_POSITION, BLOCK_REACH, BLOCK_EXCESS = 1.5, 3.0, 0.3

CATEGORIES = {"serve": "SERVE_WEIGHTS", "dig": "RECEIVE_WEIGHTS", "set": "SET_WEIGHTS", "spike": "SPIKE_WEIGHTS", "block": "BLOCK_WEIGHTS"}


def prompt(reference: float) -> Column:
    """1 less the share of `reference` by which the touch came later than its incoming speed explains; null without speed, gap or places."""
    c = F.col
    expected = distance(c("prev_x"), c("prev_y"), c("x"), c("y")) / F.when(c("speed_in") != 0, c("speed_in"))
    late = c("gap") - expected
    return clamp01(1 - F.when(late.isNotNull(), F.greatest(F.lit(0.0), late)) / reference)


def factors() -> dict[str, dict[str, Column]]:
    """Factor columns of each category.

    Columns: x, y, speed_in, speed_out, gap, apex (greatest height up to the
    next touch), height, prev_x, prev_y, set_x, set_y, spike_x, spike_y (the
    team's mean places of sets and spikes), opponent_distance (of the next
    touch's place to the nearest opponent), blockers (opponents at the net; null
    if the team is unknown).
    """
    c = F.col
    near_net = F.abs(c("x") - NET_X)
    return {
        "serve": {"speed": clamp01(c("speed_out") / SERVE_SPEED), "placement": clamp01(c("opponent_distance") / SERVE_PLACEMENT), "trajectory_height": clamp01(1 - c("apex") / SERVE_HEIGHT)},
        "dig": {"placement": clamp01(1 - distance(c("x"), c("y"), c("set_x"), c("set_y")) / RECEIVE_PLACEMENT), "reaction": prompt(RECEIVE_EXCESS), "handling_speed": clamp01(1 - c("speed_out") / RECEIVE_SPEED)},
        "set": {"placement": clamp01(1 - distance(c("x"), c("y"), c("spike_x"), c("spike_y")) / SET_PLACEMENT), "height": clamp01(1 - F.abs(c("apex") - SET_HEIGHT) / SET_HEIGHT_TOLERANCE), "time_given": clamp01(c("gap") / SET_TIME)},
        "spike": {"positioning": clamp01(1 - near_net / SPIKE_POSITION), "speed": clamp01(c("speed_out") / SPIKE_SPEED), "placement": clamp01(c("opponent_distance") / SPIKE_PLACEMENT), "blockers": clamp01(c("blockers") / SPIKE_BLOCKERS)},
        "block": {"positioning": clamp01(1 - near_net / BLOCK_POSITION), "reach": clamp01(c("height") / BLOCK_REACH), "timing": prompt(BLOCK_EXCESS)},
    }


def scored(touches: DataFrame, kind: str = "action_type", params: Params | None = None) -> DataFrame:
    """Adds `factors`, a map of the category's factors, and `score`, their weighted mean over those that aren't null."""
    params, by = params or Params(), factors()
    each = None
    score = None
    for category, weights in CATEGORIES.items():
        parts = by[category]
        made = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])
        value = weighted_score(parts, params.weights(weights))
        is_it = F.col(kind) == category
        each = F.when(is_it, made) if each is None else each.when(is_it, made)
        score = F.when(is_it, value) if score is None else score.when(is_it, value)
    return touches.withColumn("factors", each).withColumn("score", score)


def reweighted(df: DataFrame, weights: dict[str, float], factors_column: str = "factors") -> Column:
    """The weighted mean of a factor map under other weights."""
    return weighted_score({k: F.col(factors_column)[k] for k in weights}, weights)


def shortfalls(df: DataFrame, kind: str, player: str, least: float = 0.08, ignored: tuple[str, ...] = ("time_given", "blockers")) -> DataFrame:
    """(player, kind, factor, gap): the factor by which a player's mean falls furthest short of everybody's, if by more than `least`."""
    flat = df.select(player, kind, F.explode("factors").alias("factor", "v")).where(F.col("v").isNotNull() & ~F.col("factor").isin(*ignored))
    everybody = flat.groupBy(kind, "factor").agg(F.avg("v").alias("_all"))
    own = flat.where(F.col(player).isNotNull()).groupBy(player, kind, "factor").agg(F.avg("v").alias("_own"))
    gaps = own.join(F.broadcast(everybody), [kind, "factor"]).withColumn("gap", F.col("_all") - F.col("_own"))
    best = gaps.groupBy(player, kind).agg(F.max_by(F.struct("factor", "gap"), F.struct(F.round("gap", 9), "factor")).alias("_b"))
    return best.select(player, kind, F.col("_b.factor").alias("factor"), F.col("_b.gap").alias("gap")).where(F.col("gap") > least)
