"""Action quality on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import scalars
from matchlake.operators import quality, stats
from matchlake.params import Params
from matchlake.plans.bindings import TOUCHES, touches

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per touch with what the scores read. Speeds are a tenth, gaps a thousandth, to bring them into range."""
    t = touches(spark, d).withColumn("team", F.when(F.col("x") < 9.0, "A").otherwise("B"))
    w = Window.partitionBy("game", "rally").orderBy("frame", "touch_id")
    t = t.withColumns({"speed_in": F.lag("speed").over(w), "speed_out": F.col("speed"), "gap": (F.col("frame") - F.lag("frame").over(w)) / 1000.0, "apex": F.max("height").over(w.rowsBetween(0, 1)), "prev_x": F.lag("x").over(w), "prev_y": F.lag("y").over(w), "next_x": F.lead("x").over(w), "next_y": F.lead("y").over(w)})
    target = lambda k: t.where(F.col("action_type") == k).groupBy("team").agg(F.avg("x").alias(f"{k}_x"), F.avg("y").alias(f"{k}_y"))
    t = t.join(F.broadcast(target("set")), "team", "left").join(F.broadcast(target("spike")), "team", "left")
    o = t.select("game", "rally", F.col("team").alias("ot"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = t.join(o, ["game", "rally"]).where("ot <> team").groupBy("game", "touch_id").agg(F.min(scalars.distance(F.col("next_x"), F.col("next_y"), F.col("ox"), F.col("oy"))).alias("opponent_distance"), F.count_if(F.abs(F.col("ox") - 9.0) <= quality.BLOCKER_REACH).alias("_near"))
    return t.join(met, ["game", "touch_id"], "left").withColumn("blockers", F.coalesce("_near", F.lit(0)))


def _c(v: str) -> str:
    return f"CASE WHEN ({v}) IS NOT NULL THEN greatest(0.0, least(1.0, {v})) END"


def _mean(parts: dict[str, tuple[str, float]]) -> str:
    total = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in parts.values())
    weight = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in parts.values())
    return f"CASE WHEN ({weight}) > 0 THEN ({total}) / ({weight}) END"


def _late(reference: float) -> str:
    return _c(f"1 - (CASE WHEN gap - sqrt(pow(x - prev_x, 2) + pow(y - prev_y, 2)) / nullif(speed_in, 0) IS NOT NULL THEN greatest(0.0, gap - sqrt(pow(x - prev_x, 2) + pow(y - prev_y, 2)) / nullif(speed_in, 0)) END) / {reference}")


def _factors() -> dict[str, dict[str, str]]:
    q = quality
    return {
        "serve": {"speed": _c(f"speed / {q.SERVE_SPEED}"), "placement": _c(f"opponent_distance / {q.SERVE_PLACEMENT}"), "trajectory_height": _c(f"1 - apex / {q.SERVE_HEIGHT}")},
        "dig": {"placement": _c(f"1 - sqrt(pow(x - set_x, 2) + pow(y - set_y, 2)) / {q.RECEIVE_PLACEMENT}"), "reaction": _late(q.RECEIVE_EXCESS), "handling_speed": _c(f"1 - speed / {q.RECEIVE_SPEED}")},
        "set": {"placement": _c(f"1 - sqrt(pow(x - spike_x, 2) + pow(y - spike_y, 2)) / {q.SET_PLACEMENT}"), "height": _c(f"1 - abs(apex - {q.SET_HEIGHT}) / {q.SET_HEIGHT_TOLERANCE}"), "time_given": _c(f"gap / {q.SET_TIME}")},
        "spike": {"positioning": _c(f"1 - abs(x - 9.0) / {q.SPIKE_POSITION}"), "speed": _c(f"speed / {q.SPIKE_SPEED}"), "placement": _c(f"opponent_distance / {q.SPIKE_PLACEMENT}"), "blockers": _c(f"blockers / {float(q.SPIKE_BLOCKERS)}")},
        "block": {"positioning": _c(f"1 - abs(x - 9.0) / {q.BLOCK_POSITION}"), "reach": _c(f"height / {q.BLOCK_REACH}"), "timing": _late(q.BLOCK_EXCESS)},
    }


def _sql() -> str:
    q, p, columns = quality, Params(), _factors()
    cases = " ".join(f"WHEN '{k}' THEN {_mean({n: (c, p.weights(q.CATEGORIES[k])[n]) for n, c in cs.items()})}" for k, cs in columns.items())
    return f"""{TOUCHES},
sided AS (SELECT *, CASE WHEN x < 9.0 THEN 'A' ELSE 'B' END AS team FROM touches),
means AS (SELECT team, avg(x) FILTER (action_type = 'set') AS set_x, avg(y) FILTER (action_type = 'set') AS set_y, avg(x) FILTER (action_type = 'spike') AS spike_x, avg(y) FILTER (action_type = 'spike') AS spike_y FROM sided GROUP BY team),
lined AS (SELECT *, lag(speed) OVER w AS speed_in, (frame - lag(frame) OVER w) / 1000.0 AS gap, max(height) OVER (PARTITION BY game, rally ORDER BY frame, touch_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS apex,
 lag(x) OVER w AS prev_x, lag(y) OVER w AS prev_y, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y FROM sided WINDOW w AS (PARTITION BY game, rally ORDER BY frame, touch_id)),
met AS (SELECT t.game, t.touch_id, min(sqrt(pow(o.x - t.next_x, 2) + pow(o.y - t.next_y, 2))) AS opponent_distance, count(*) FILTER (abs(o.x - 9.0) <= {q.BLOCKER_REACH}) AS near FROM lined t JOIN lined o ON t.game = o.game AND t.rally = o.rally AND t.team <> o.team GROUP BY ALL),
wide AS (SELECT l.*, m.set_x, m.set_y, m.spike_x, m.spike_y, met.opponent_distance, coalesce(met.near, 0) AS blockers FROM lined l LEFT JOIN means m USING (team) LEFT JOIN met USING (game, touch_id)),
scored AS (SELECT *, CASE action_type {cases} END AS score FROM wide)"""


SCORED = _sql()
_FLAT = " UNION ALL ".join(f"SELECT player, action_type, '{n}' AS factor, {c} AS v FROM wide WHERE action_type = '{k}'" for k, cs in _factors().items() for n, c in cs.items() if n not in ("time_given", "blockers"))
_SERVE = scalars.redistributed(Params().weights("SERVE_WEIGHTS"), "placement", 0.6)


@query(f"WITH {SCORED} SELECT game, touch_id, action_type, round(score, 10) AS score FROM scored")
def action_quality(spark: SparkSession, d: str) -> DataFrame:
    """The score of every touch."""
    return quality.scored(wide(spark, d)).select("game", "touch_id", "action_type", F.round("score", 10).alias("score"))


@query(f"WITH {SCORED} SELECT game, action_type, count(*) AS n, count(score) AS scored, round(avg(score), 6) AS average FROM scored GROUP BY game, action_type")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(quality.scored(wide(spark, d)), ["game", "action_type"], "score").withColumn("average", F.round("average", 6))


@query(f"""WITH {SCORED}, g AS (SELECT player, game, action_type, avg(score) AS a, count(score) AS n FROM scored GROUP BY ALL)
SELECT player, action_type, round(sum(a * n) / nullif(sum(CASE WHEN a IS NOT NULL THEN n END), 0), 6) AS average, round(median(a), 6) AS median, count(a) AS games FROM g GROUP BY player, action_type""")
def quality_across_games(spark: SparkSession, d: str) -> DataFrame:
    """Count-weighted mean and median of a player's averages by game."""
    g = quality.scored(wide(spark, d)).groupBy("player", "game", "action_type").agg(F.avg("score").alias("a"), F.count("score").alias("n"))
    return g.groupBy("player", "action_type").agg(r6(stats.weighted_mean("a", "n"), "average"), r6(F.median("a"), "median"), F.count("a").alias("games"))


@query(f"""WITH {SCORED}, flat AS ({_FLAT}), e AS (SELECT action_type, factor, avg(v) AS a FROM flat GROUP BY ALL), o AS (SELECT player, action_type, factor, avg(v) AS b FROM flat GROUP BY ALL HAVING count(v) > 0),
g AS (SELECT player, action_type, factor, a - b AS gap FROM o JOIN e USING (action_type, factor)), r AS (SELECT *, row_number() OVER (PARTITION BY player, action_type ORDER BY round(gap, 9) DESC, factor DESC) AS k FROM g) SELECT player, action_type, factor, round(gap, 6) AS gap FROM r WHERE k = 1 AND gap > 0.08""")
def quality_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    """Each player's biggest shortfall by category."""
    return quality.shortfalls(quality.scored(wide(spark, d)), "action_type", "player").withColumn("gap", F.round("gap", 6))


@query(f"WITH {SCORED} SELECT game, touch_id, round({_mean({n: (c, _SERVE[n]) for n, c in _factors()['serve'].items()})}, 10) AS score FROM scored WHERE action_type = 'serve'")
def quality_reweighted(spark: SparkSession, d: str) -> DataFrame:
    """Serve scores under a placement weight of 0.6, the others rescaled."""
    weights = scalars.redistributed(Params().weights("SERVE_WEIGHTS"), "placement", 0.6)
    t = quality.scored(wide(spark, d)).where("action_type = 'serve'")
    return t.select("game", "touch_id", F.round(quality.reweighted(t, weights), 10).alias("score"))


@query(f"""WITH {SCORED}, m AS (SELECT team, action_type, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM scored WHERE action_type IN ('set', 'spike') GROUP BY ALL) SELECT team, action_type, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, n FROM m""")
def learned_targets(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).where("action_type in ('set', 'spike')").withColumn("team", F.when(F.col("x") < 9.0, "A").otherwise("B"))
    return t.groupBy("team", "action_type").agg(r6(F.avg("x"), "mean_x"), r6(F.avg("y"), "mean_y"), F.count("*").alias("n"))
