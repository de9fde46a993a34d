"""Aggregations of touches, rallies, sets and games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ["serve", "dig", "set", "spike", "block", "hit"]


def consolidated(touches: DataFrame, game: str = "game", player: str = "player", rally: str = "rally", time: str = "frame", kind: str = "action_type") -> DataFrame:
    """Per game and player: hits, hits by type (zeros kept), distinct rallies, rallies ended by their last touch, and the rate of those.

    A rally's last touch is the one of the greatest time among all its touches,
    also those without a player.  Touches without a player count for nobody.
    """
    w = Window.partitionBy(game, rally)
    last = touches.withColumn("_end", (F.col(rally).isNotNull() & (F.col(time) == F.max(time).over(w))).cast("long"))
    counts = [F.sum((F.col(kind) == t).cast("long")).alias(f"n_{t}") for t in TYPES]
    out = last.where(F.col(player).isNotNull()).groupBy(game, player).agg(F.count(F.lit(1)).alias("total_hits"), *counts, F.countDistinct(rally).alias("rallies"), F.sum("_end").alias("ending_touches"))
    return out.withColumn("ending_rate", F.col("ending_touches") / F.col("total_hits"))


def ordered_mean(df: DataFrame, keys: list[str], x: str, order: list[str], mean: str) -> DataFrame:
    """(keys, mean, n) of the values of x that aren't null, added one after another in the order given.

    Sums of parts differ in the last digits with how the rows are dealt out,
    which turns means at a limit or at half a rounding step; these don't.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.where(F.col(x).isNotNull()).select(*keys, F.sum(x).over(w).alias("_sum"), F.row_number().over(w).alias("_n"))
    return sums.groupBy(*keys).agg((F.max_by("_sum", "_n") / F.max("_n")).alias(mean), F.max("_n").cast("long").alias("n"))


def sides(samples: DataFrame, keys: list[str], x: str, order: list[str], middle: float = 9.0, least: int = 5) -> DataFrame:
    """The side of each key by its mean x, from at least `least` samples, added up in the order given."""
    out = ordered_mean(samples, keys, x, order, "mean_x").where(F.col("n") >= least)
    return out.withColumn("side", F.when(F.col("mean_x") < middle, "A").otherwise("B"))


def rally_winners(rallies: DataFrame, game: str, rally: str, start_side: Column, end_side: Column, other: dict[str, str]) -> DataFrame:
    """Who won each rally: the side that starts the next one, else the opposite of the side where this one ended."""
    flip = F.create_map(*[F.lit(v) for kv in other.items() for v in kv])
    following = F.lead(start_side).over(Window.partitionBy(game).orderBy(rally))
    return rallies.withColumn("winner", F.coalesce(following, flip[end_side]))


def winner(counts: Column, others: Column, a: str, b: str) -> Column:
    """a or b, whichever has more; null if equal."""
    return F.when(counts > others, a).when(others > counts, b)


def radar(touched: DataFrame, keys: list[str], kind: str, won: Column) -> DataFrame:
    """Share of won rows by key and type; null without rows."""
    return touched.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("total"), F.sum(won.cast("long")).alias("wins")).withColumn("rate", F.expr("try_divide(wins, total)"))


def summary(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rows, scored rows and mean score by key; null scores don't count into the mean."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("scored"), F.avg(score).alias("average"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.expr(f"try_divide(sum({value} * {weight}), sum(case when {value} is not null then {weight} end))")


def mode_first(df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "mode") -> DataFrame:
    """The most frequent value of each key; of equals the one met first in the order."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_at"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), "_at")).alias(name))


def histogram_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1 - sum of min shares of two histograms given cell by cell; null if one is empty."""
    na, nb = sum(a.values()), sum(b.values())
    return F.when((na > 0) & (nb > 0), 1 - sum(F.least(a[k] / na, b[k] / nb) for k in a))


def plausible_range(df: DataFrame, value: str, width: float = 1.5, least: int = 30) -> DataFrame:
    """(low, high): mean +- width population deviations, low at least 0; nulls under `least` samples."""
    out = df.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    enough = F.col("n") >= least
    return out.select(F.when(enough, F.greatest(F.lit(0.0), F.col("m") - width * F.col("s"))).alias("low"), F.when(enough, F.col("m") + width * F.col("s")).alias("high"))


def truncated_percentile(values: str, share: float) -> Column:
    """sorted[int(share * (n - 1))] of a group's values (collected per group)."""
    s = F.sort_array(F.collect_list(values))
    return F.element_at(s, (F.floor(F.lit(share) * (F.size(s) - 1)) + 1).cast("int"))


def detection_quality(df: DataFrame, keys: list[str], time: str, seen: Column, x: str, y: str) -> DataFrame:
    """Detection rate, gaps (runs of misses), the longest, and mean step between detections of adjacent frames."""
    w = Window.partitionBy(*keys).orderBy(time)
    rows = df.withColumn("_seen", seen.cast("int"))
    prior = F.lag("_seen").over(w)
    step = F.when((F.col("_seen") == 1) & (prior == 1) & (F.col(time) - F.lag(time).over(w) == 1), F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)))
    rows = rows.withColumns({"_step": step, "_open": ((F.col("_seen") == 0) & (F.coalesce(prior, F.lit(1)) == 1)).cast("int")})
    rows = rows.withColumn("_gap", F.when(F.col("_seen") == 0, F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    longest = rows.where("_gap is not null").groupBy(*keys, "_gap").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("max_gap"))
    out = rows.groupBy(*keys).agg(F.avg("_seen").alias("rate"), F.sum("_open").alias("gaps"), F.avg("_step").alias("jitter"))
    return out.join(longest, keys, "left").withColumn("max_gap", F.coalesce("max_gap", F.lit(0)))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """total / (classes * count) of each label."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counted.join(F.broadcast(total)).select(label, (F.col("total") / (classes * F.greatest(F.lit(1), F.col("n")))).alias("weight"))


def fit_line(t: Column, v: Column) -> tuple[Column, Column]:
    """Intercept and slope of v over t."""
    return F.regr_intercept(v, t), F.regr_slope(v, t)


def fit_fall(t: Column, z: Column, g: float = 9.81) -> tuple[Column, Column]:
    """Start height and speed of a free flight: z + g t^2 / 2 regressed on t."""
    return fit_line(t, z + 0.5 * g * t * t)


def fit_parabola(df: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """(keys, a, b, c, n) of v = a t^2 + b t + c by power sums; nulls if the points don't determine it."""
    p = [F.sum(F.pow(F.col(t), k)).alias(f"s{k}") for k in range(5)] + [F.sum(F.pow(F.col(t), k) * F.col(v)).alias(f"v{k}") for k in range(3)]
    s = df.where(F.col(t).isNotNull() & F.col(v).isNotNull()).groupBy(*keys).agg(*p)

    def det(m: list[list[str]]) -> Column:
        c = [[F.col(x) for x in r] for r in m]
        return c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])

    d = det([["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "s0"]])
    over = lambda m: F.when(F.abs(d) > 1e-12, det(m) / d)
    return s.select(*keys, over([["v2", "s3", "s2"], ["v1", "s2", "s1"], ["v0", "s1", "s0"]]).alias("a"), over([["s4", "v2", "s2"], ["s3", "v1", "s1"], ["s2", "v0", "s0"]]).alias("b"), over([["s4", "s3", "v2"], ["s3", "s2", "v1"], ["s2", "s1", "v0"]]).alias("c"), F.col("s0").cast("long").alias("n"))


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def any_else_all(df: DataFrame, keys: list[str], good: Column) -> DataFrame:
    """Each key's good rows, or all its rows if none is good."""
    return df.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_any", F.max("_good").over(Window.partitionBy(*keys))).where("_good or not _any").drop("_good", "_any")
