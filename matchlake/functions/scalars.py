"""Null-aware scalar functions. A null operand gives null unless it says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(v: Column) -> Column:
    """v held to [0, 1]; null stays null (greatest and least would skip it)."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Degrees between two vectors; null if either is shorter than 1e-6."""
    nu, nv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cosine = (ux * vx + uy * vy) / (nu * nv)
    return F.when((nu >= 1e-6) & (nv >= 1e-6), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def velocity(d: Column, dt: Column) -> Column:
    """d / dt; null if dt is not positive."""
    return F.when(dt > 0, d / dt)


def project(h: list[float] | list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A homography's image of (x, y); null where its denominator is 0."""
    h = [c if isinstance(c, Column) else F.lit(float(c)) for c in h]
    w = h[6] * x + h[7] * y + h[8]
    return F.when(w != 0, (h[0] * x + h[1] * y + h[2]) / w), F.when(w != 0, (h[3] * x + h[4] * y + h[5]) / w)


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def box_diagonal(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def box_aspect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Width by height, heights under 1 counting as 1."""
    return (x2 - x1) / F.greatest(F.lit(1.0), y2 - y1)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 if the union is empty."""
    both = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = box_area(*a) + box_area(*b) - both
    return F.when(union > 0, both / union).when(union.isNotNull(), 0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def half_cosine_distance(a: Column, b: Column) -> Column:
    """(1 - dot) / 2 held to [0, 1]; 1 if a vector is missing."""
    return F.coalesce(clamp01((1 - dot(a, b)) / 2), F.lit(1.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def shape_bin(ratio: Column, edges: tuple[float, ...] = (0.45, 0.70, 1.0)) -> Column:
    """How many edges the ratio reaches."""
    return reduce(lambda s, e: s + F.when(ratio >= e, 1).otherwise(0), edges, F.lit(0))


def noisy_or(a: Column, b: Column) -> Column:
    return 1 - (1 - a) * (1 - b)


def outside(v: Column, low: Column, high: Column) -> Column:
    """How far v lies outside [low, high]."""
    return F.greatest(F.lit(0.0), low - v, v - high)


def zone_cell(x: Column, y: Column, half: float = 9.0, depth: float = 4.5, column: float = 3.0) -> Column:
    """One of 12 court cells: side, depth from the net, and three columns."""
    side = F.when(x < half, 0).otherwise(1)
    deep = F.when(F.abs(x - half) < depth, 0).otherwise(1)
    across = F.greatest(F.lit(0), F.least(F.lit(2), F.floor(y / column).cast("int")))
    return F.when(x.isNotNull() & y.isNotNull(), side * 6 + deep * 3 + across)


def speed_label(speed: Column, real: Column) -> Column:
    """Whole km/h of real speeds in m/s, else pixels per second, halves to even."""
    whole = lambda v: F.bround(v, 0).cast("long")
    return F.when(real, F.format_string("%d km/h", whole(speed * 3.6))).otherwise(F.format_string("%d px/s", whole(speed)))


def weighted_score(factors: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of w * f over sum of w, over the factors that aren't null; null if none is."""
    total = reduce(lambda s, k: s + F.coalesce(factors[k] * weights[k], F.lit(0.0)), weights, F.lit(0.0))
    weight = reduce(lambda s, k: s + F.when(factors[k].isNotNull(), weights[k]).otherwise(0.0), weights, F.lit(0.0))
    return F.when(weight > 0, total / weight)


def redistributed(weights: dict[str, float], name: str, value: float) -> dict[str, float]:
    """Weights after one is set: the others keep their proportions in what is left (equal parts if they were all 0)."""
    rest = {k: w for k, w in weights.items() if k != name}
    total = sum(rest.values())
    return {k: value if k == name else ((1 - value) * rest[k] / total if total else (1 - value) / len(rest)) for k in weights}


def is_digits(s: Column) -> Column:
    return s.rlike(r"^\d+$")


def named(s: Column) -> Column:
    """The trimmed name; null if blank."""
    return F.when(F.length(F.trim(s)) > 0, F.trim(s))


def normalised(value: Column, allowed: list[str], default: str) -> Column:
    """value if it is allowed, else default (also for null)."""
    return F.when(value.isin(*allowed), value).otherwise(default)


# Metres of the court around which play counts, lengthwise and across, for feet and for players' places.
PLAY_AREA, COURT_RANGE = ((-6.0, 24.0), (0.0, 9.0)), ((-5.0, 23.0), (-1.5, 10.5))
# Share by which a box is padded, width of an isolation bucket, bucket of a box that is alone.
PADDING, BUCKET, ALONE = 0.18, 0.25, 99.0
# m/s above which a speed is no measurement; confidence and overlap of a detected action.
TOP_SPEED, DETECTED, OVERLAP = 45.0, 0.6, 0.1


def in_play_area(x: Column, y: Column, calibrated: Column) -> Column:
    """A foot point inside the play area; without calibration every point is."""
    (x1, x2), (y1, y2) = PLAY_AREA
    return ~F.coalesce(calibrated, F.lit(False)) | F.coalesce(x.between(x1, x2) & y.between(y1, y2), F.lit(False))


def in_court_range(x: Column, y: Column) -> Column:
    """A place inside the court and its surroundings; false for an unknown place."""
    (x1, x2), (y1, y2) = COURT_RANGE
    return F.coalesce(x.between(x1, x2) & y.between(y1, y2), F.lit(False))


def measured(interpolated: Column, pixel: Column) -> Column:
    """A point that was seen, not filled in."""
    return ~F.coalesce(interpolated, F.lit(False)) & pixel.isNotNull()


def plausible_speed(speed: Column, most: float = TOP_SPEED) -> Column:
    """The speed; null above what a ball can have."""
    return F.when(speed <= most, speed)


def sure_action(confidence: Column, overlap: Column, least: float = DETECTED) -> Column:
    """A detected action that is sure enough and meets a player's box."""
    return F.coalesce((confidence >= least) & (overlap >= OVERLAP), F.lit(False))


def effective_range(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Start (else 0) and end (else the duration, else without end)."""
    return F.coalesce(start, F.lit(0.0)), F.coalesce(end, duration, F.lit(float("inf")))


def isolation_bucket(gap: Column) -> Column:
    """Widths of free room beside a box in steps of BUCKET, halves to even; ALONE without a neighbour."""
    return F.coalesce(F.bround(gap / BUCKET, 0), F.lit(ALONE))


def padded(x1: Column, y1: Column, x2: Column, y2: Column, share: float = PADDING) -> tuple[Column, ...]:
    """A box with a margin of a share of its size on every side."""
    w, h = (x2 - x1) * share, (y2 - y1) * share
    return x1 - w, y1 - h, x2 + w, y2 + h


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Two boxes share more than an edge."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def side_of(a: Column, b: Column) -> tuple[Column, Column]:
    """The side with more samples (A if equal) and its share of them; null and 0 without samples."""
    some = a + b > 0
    return F.when(some, F.when(a >= b, "A").otherwise("B")), F.when(some, F.greatest(a, b) / (a + b)).otherwise(0.0)


def bin_penalty(a: Column, b: Column) -> Column:
    """What comparing galleries of two shape bins costs."""
    return 0.2 * F.abs(a - b) / 3
