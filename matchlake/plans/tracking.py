"""Touches, rallies, sets and games: joins, ordered operators and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import scalars
from matchlake.operators import asof, intervals, ordered, spatial, stats, upserts
from matchlake.plans.bindings import RALLIES, TOUCHES, rallies, table, touches

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


_COUNTS = ", ".join(f"CAST(sum(CASE WHEN action_type = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{t}" for t in stats.TYPES)


@query(f"""WITH {TOUCHES}, e AS (SELECT *, CASE WHEN frame = max(frame) OVER (PARTITION BY game, rally) THEN 1 ELSE 0 END AS ends FROM touches)
SELECT game, player, count(*) AS total_hits, {_COUNTS}, count(DISTINCT rally) AS rallies, CAST(sum(ends) AS BIGINT) AS ending_touches,
round(sum(ends) / count(*), 6) AS ending_rate FROM e GROUP BY game, player""")
def player_consolidation(spark: SparkSession, d: str) -> DataFrame:
    return stats.consolidated(touches(spark, d)).withColumn("ending_rate", F.round("ending_rate", 6))


@query(f"WITH {TOUCHES} SELECT game, touch_id, player, rally FROM touches")
def rally_sessions(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).select("game", "touch_id", "player", F.col("rally").cast("long").alias("rally"))


@query(f"""WITH {RALLIES} SELECT game, rally, start, "end", n FROM rallies WHERE n >= 3""")
def rally_windows(spark: SparkSession, d: str) -> DataFrame:
    return rallies(spark, d).where("n >= 3").select("game", F.col("rally").cast("long").alias("rally"), "start", "end", "n")


@query(f"WITH {TOUCHES} SELECT game, touch_id, lag(action_type) OVER w AS prev_action_type, lead(action_type) OVER w AS next_action_type, frame - lag(frame) OVER w AS since_previous FROM touches WINDOW w AS (PARTITION BY game, rally ORDER BY frame, touch_id)")
def touch_neighbours(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.neighbours(touches(spark, d), ["game", "rally"], ["frame", "touch_id"], ["action_type", "frame"])
    return out.select("game", "touch_id", "prev_action_type", "next_action_type", (F.col("frame") - F.col("prev_frame")).alias("since_previous"))


@query(f"""WITH {RALLIES} SELECT game, rally, coalesce(lead(start_side) OVER (PARTITION BY game ORDER BY rally), CASE end_side WHEN 'A' THEN 'B' ELSE 'A' END) AS winner FROM rallies""")
def rally_winners(spark: SparkSession, d: str) -> DataFrame:
    out = stats.rally_winners(rallies(spark, d), "game", "rally", F.col("start_side"), F.col("end_side"), {"A": "B", "B": "A"})
    return out.select("game", F.col("rally").cast("long").alias("rally"), "winner")


_WON = RALLIES + """, won AS (SELECT game, rally, set_index, coalesce(lead(start_side) OVER (PARTITION BY game ORDER BY rally), CASE end_side WHEN 'A' THEN 'B' ELSE 'A' END) AS winner FROM rallies)"""


def _won(spark: SparkSession, d: str) -> DataFrame:
    return stats.rally_winners(rallies(spark, d), "game", "rally", F.col("start_side"), F.col("end_side"), {"A": "B", "B": "A"})


@query(f"""WITH {_WON}, s AS (SELECT game, set_index, count(*) FILTER (winner = 'A') AS a, count(*) FILTER (winner = 'B') AS b FROM won GROUP BY game, set_index)
SELECT game, count(*) AS sets, count(*) FILTER (a > b) AS sets_a, count(*) FILTER (b > a) AS sets_b,
CASE WHEN count(*) FILTER (a > b) > count(*) FILTER (b > a) THEN 'A' WHEN count(*) FILTER (b > a) > count(*) FILTER (a > b) THEN 'B' END AS winner FROM s GROUP BY game""")
def match_winners(spark: SparkSession, d: str) -> DataFrame:
    """Set winner: more rallies; match winner: more sets; nobody at a tie."""
    sets = _won(spark, d).groupBy("game", "set_index").agg(F.count_if(F.col("winner") == "A").alias("a"), F.count_if(F.col("winner") == "B").alias("b"))
    sets = sets.withColumn("w", stats.winner(F.col("a"), F.col("b"), "A", "B"))
    out = sets.groupBy("game").agg(F.count("*").alias("sets"), F.count_if(F.col("w") == "A").alias("sets_a"), F.count_if(F.col("w") == "B").alias("sets_b"))
    return out.withColumn("winner", stats.winner(F.col("sets_a"), F.col("sets_b"), "A", "B"))


@query(f"WITH {_WON} SELECT game, rally, CAST(sum(CASE winner WHEN 'A' THEN 1 WHEN 'B' THEN -1 ELSE 0 END) OVER (PARTITION BY game ORDER BY rally) AS BIGINT) AS momentum FROM won")
def momentum(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.running_differential(_won(spark, d), ["game"], ["rally"], F.col("winner") == "A", F.col("winner") == "B")
    return out.select("game", F.col("rally").cast("long").alias("rally"), "momentum")


@query(f"""WITH {TOUCHES} SELECT game, player, count(x) AS n, round(avg(x), 6) AS mean_x, CASE WHEN avg(x) < 9.0 THEN 'A' ELSE 'B' END AS side FROM touches GROUP BY game, player HAVING count(x) >= 5""")
def side_assignment(spark: SparkSession, d: str) -> DataFrame:
    return stats.sides(touches(spark, d), ["game", "player"], "x", ["frame", "touch_id"]).withColumn("mean_x", F.round("mean_x", 6))


@query(f"""WITH {_WON}, t AS (SELECT DISTINCT game, rally, CASE WHEN x < 9.0 THEN 'A' ELSE 'B' END AS side, action_type FROM touches WHERE action_type <> 'hit')
SELECT game, side, action_type, count(*) AS total, CAST(sum(CASE WHEN winner = side THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(sum(CASE WHEN winner = side THEN 1 ELSE 0 END) / count(*), 6) AS rate
FROM t JOIN won USING (game, rally) GROUP BY game, side, action_type""")
def team_radar(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).where("action_type <> 'hit'").select("game", "rally", F.when(F.col("x") < 9.0, "A").otherwise("B").alias("side"), "action_type").distinct()
    out = stats.radar(t.join(_won(spark, d).select("game", "rally", "winner"), ["game", "rally"]), ["game", "side"], "action_type", F.col("winner") == F.col("side"))
    return out.withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_WON} SELECT player, action_type, count(*) AS total, CAST(sum(CASE WHEN winner = CASE WHEN x < 9.0 THEN 'A' ELSE 'B' END THEN 1 ELSE 0 END) AS BIGINT) AS wins,
round(sum(CASE WHEN winner = CASE WHEN x < 9.0 THEN 'A' ELSE 'B' END THEN 1 ELSE 0 END) / count(*), 6) AS rate, count(DISTINCT game) AS games FROM touches JOIN won USING (game, rally) GROUP BY player, action_type""")
def player_radar(spark: SparkSession, d: str) -> DataFrame:
    """Win rates by touch, with the number of games that give data."""
    t = touches(spark, d).join(_won(spark, d).select("game", "rally", "winner"), ["game", "rally"])
    won = (F.col("winner") == F.when(F.col("x") < 9.0, "A").otherwise("B")).cast("long")
    out = t.groupBy("player", "action_type").agg(F.count("*").alias("total"), F.sum(won).alias("wins"), F.countDistinct("game").alias("games"))
    return out.withColumn("rate", F.round(F.col("wins") / F.col("total"), 6))


@query(f"""WITH {_WON}, s AS (SELECT game, player, CASE WHEN avg(x) < 9.0 THEN 'A' ELSE 'B' END AS side FROM touches GROUP BY game, player HAVING count(x) >= 5),
n AS (SELECT game, count(*) FILTER (side = 'A') AS players_a, count(*) FILTER (side = 'B') AS players_b FROM s GROUP BY game),
w AS (SELECT game, count(*) FILTER (winner = 'A') AS wins_a, count(*) FILTER (winner = 'B') AS wins_b FROM won GROUP BY game)
SELECT game, players_a, players_b, CASE WHEN players_a > 0 AND players_b > 0 THEN wins_a END AS wins_a, CASE WHEN players_a > 0 AND players_b > 0 THEN wins_b END AS wins_b FROM n JOIN w USING (game)""")
def matchup(spark: SparkSession, d: str) -> DataFrame:
    """Rallies won by side, where both sides have players."""
    s = stats.sides(touches(spark, d), ["game", "player"], "x", ["frame", "touch_id"]).groupBy("game").agg(F.count_if(F.col("side") == "A").alias("players_a"), F.count_if(F.col("side") == "B").alias("players_b"))
    w = _won(spark, d).groupBy("game").agg(F.count_if(F.col("winner") == "A").alias("wins_a"), F.count_if(F.col("winner") == "B").alias("wins_b"))
    both = (F.col("players_a") > 0) & (F.col("players_b") > 0)
    return s.join(w, "game").select("game", "players_a", "players_b", F.when(both, F.col("wins_a")).alias("wins_a"), F.when(both, F.col("wins_b")).alias("wins_b"))


@query(f"""WITH {TOUCHES}, p AS (SELECT game, frame, min(touch_id) AS other FROM touches WHERE action_type = 'spike' GROUP BY game, frame)
SELECT t.game, t.touch_id, CASE WHEN a.frame IS NULL OR (b.frame IS NOT NULL AND t.frame - b.frame <= a.frame - t.frame) THEN b.frame ELSE a.frame END AS near_time,
CASE WHEN a.frame IS NULL OR (b.frame IS NOT NULL AND t.frame - b.frame <= a.frame - t.frame) THEN b.other ELSE a.other END AS near_other
FROM touches t ASOF LEFT JOIN p b ON t.game = b.game AND t.frame >= b.frame ASOF LEFT JOIN p a ON t.game = a.game AND t.frame <= a.frame""")
def nearest_spike(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    p = t.where("action_type = 'spike'").groupBy("game", "frame").agg(F.min("touch_id").alias("other"))
    return asof.nearest(t.select("game", "touch_id", "frame"), p, ["game"], "frame", "frame", ["other"], prefix="near_").drop("frame")


@query(f"""WITH {TOUCHES}, p AS (SELECT game, frame, max(touch_id) AS other FROM touches WHERE action_type = 'serve' GROUP BY game, frame)
SELECT t.game, t.touch_id, b.frame AS asof_time, b.other AS asof_other FROM touches t ASOF LEFT JOIN p b ON t.game = b.game AND t.frame >= b.frame""")
def latest_serve(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    p = t.where("action_type = 'serve'").groupBy("game", "frame").agg(F.max("touch_id").alias("other"))
    return asof.backward(t.select("game", "touch_id", "frame"), p, ["game"], "frame", "frame", ["other"]).drop("frame")


@query(f"""WITH {TOUCHES}, p AS (SELECT game, frame, max(touch_id) AS other FROM touches WHERE action_type = 'set' GROUP BY game, frame)
SELECT t.game, t.touch_id, CASE WHEN a.frame - t.frame <= 7200 THEN a.frame END AS asof_time, CASE WHEN a.frame - t.frame <= 7200 THEN a.other END AS asof_other
FROM touches t ASOF LEFT JOIN p a ON t.game = a.game AND t.frame < a.frame""")
def next_set_soon(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    p = t.where("action_type = 'set'").groupBy("game", "frame").agg(F.max("touch_id").alias("other"))
    return asof.forward(t.select("game", "touch_id", "frame"), p, ["game"], "frame", "frame", ["other"], within=7200, strict=True).drop("frame")


@query(f"""WITH {RALLIES} SELECT t.game, t.touch_id, r.rally FROM touches t JOIN (SELECT * FROM rallies WHERE n >= 3) r ON t.game = r.game AND t.frame BETWEEN r.start AND r."end" """)
def touch_in_rally(spark: SparkSession, d: str) -> DataFrame:
    """Range join of touches and rally windows."""
    r = rallies(spark, d).where("n >= 3").select("game", F.col("rally").cast("long").alias("rally"), "start", "end")
    return intervals.containing(touches(spark, d).select("game", "touch_id", "frame"), r, ["game"], "frame", "start", "end", 14_400, pick="start").select("game", "touch_id", "rally")


@query(f"""WITH {RALLIES}, g AS (SELECT game, set_index, min(rally) AS lo, max(rally) AS hi FROM rallies GROUP BY game, set_index)
SELECT r.game, r.rally, g.set_index FROM rallies r JOIN g ON r.game = g.game AND r.rally BETWEEN g.lo AND g.hi""")
def rally_in_set(spark: SparkSession, d: str) -> DataFrame:
    r = rallies(spark, d).withColumn("rally", F.col("rally").cast("long"))
    g = r.groupBy("game", "set_index").agg(F.min("rally").alias("lo"), F.max("rally").alias("hi"))
    return intervals.containing(r.select("game", "rally"), g, ["game"], "rally", "lo", "hi", 4, pick="set_index").select("game", "rally", "set_index")


@query(f"""WITH {TOUCHES}, c AS (SELECT game, touch_id, list(action_type) OVER (PARTITION BY game ORDER BY frame, touch_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM touches),
u AS (SELECT game, touch_id, v, count(*) AS n, min(i) AS first FROM (SELECT game, touch_id, unnest(w) AS v, unnest(range(len(w))) AS i FROM c) GROUP BY ALL)
SELECT game, touch_id, arg_min(v, row(-n, first)) AS smoothed FROM u GROUP BY game, touch_id""")
def smoothed_types(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.majority(touches(spark, d), ["game"], ["frame", "touch_id"], "action_type", stats.TYPES)
    return out.select("game", "touch_id", "smoothed")


@query(f"""WITH {TOUCHES}, c AS (SELECT game, row_number() OVER (PARTITION BY game ORDER BY frame, touch_id) - 1 AS chunk, CASE WHEN action_type = 'serve' THEN 'service' WHEN action_type IN ('set', 'dig') THEN 'play' ELSE 'no-play' END AS label FROM touches),
w AS (SELECT game, chunk, list(label) OVER (PARTITION BY game ORDER BY chunk ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w, count(*) OVER (PARTITION BY game) * 8 - 3 AS frames FROM c),
u AS (SELECT game, chunk, frames, v, count(*) AS n, min(i) AS first FROM (SELECT game, chunk, frames, unnest(w) AS v, unnest(range(len(w))) AS i FROM w) GROUP BY ALL),
s AS (SELECT game, chunk, frames, arg_min(v, row(-n, first)) AS label FROM u GROUP BY game, chunk, frames),
l AS (SELECT *, CASE WHEN chunk - lag(chunk) OVER (PARTITION BY game ORDER BY chunk) > 3 THEN 1 ELSE 0 END AS new FROM s WHERE label <> 'no-play'),
r AS (SELECT *, sum(new) OVER (PARTITION BY game ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS k FROM l),
g AS (SELECT game, k, min(chunk) AS a, least((max(chunk) + 1) * 8, max(frames)) - 1 AS e FROM r GROUP BY game, k HAVING max(chunk) - min(chunk) + 1 >= 4)
SELECT game, row_number() OVER (PARTITION BY game ORDER BY a) - 1 AS rally, a * 8 AS start_frame, e AS end_frame, round((e - a * 8) / 24.0, 6) AS duration FROM g""")
def status_rallies(spark: SparkSession, d: str) -> DataFrame:
    """Rallies of games whose touches stand for chunks of a film: labels smoothed, gaps bridged, short ones left out."""
    t = touches(spark, d)
    w = Window.partitionBy("game")
    label = F.when(F.col("action_type") == "serve", "service").when(F.col("action_type").isin("set", "dig"), "play").otherwise("no-play")
    chunks = t.select("game", (F.row_number().over(w.orderBy("frame", "touch_id")) - 1).cast("long").alias("chunk"), label.alias("label"), (F.count("*").over(w) * 8 - 3).alias("frames"))
    out = ordered.live_rallies(chunks, ["game"], "chunk", "label", ["no-play", "play", "service"], ["play", "service"], 24.0, 8, "frames")
    return out.withColumn("duration", r6(F.col("duration"), "duration"))


@query(f"""WITH {TOUCHES}, m AS (SELECT *, CASE WHEN lag(action_type) OVER w = action_type THEN 0 ELSE 1 END AS s FROM touches WINDOW w AS (PARTITION BY game ORDER BY frame, touch_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY game ORDER BY frame, touch_id ROWS UNBOUNDED PRECEDING) - 1 AS island FROM m)
SELECT game, CAST(island AS BIGINT) AS island, min(action_type) AS action_type, count(*) AS n, min(frame) AS start, max(frame) AS "end" FROM i GROUP BY game, island""")
def type_islands(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.islands(touches(spark, d), ["game"], ["frame", "touch_id"], F.col("action_type"))
    return out.groupBy("game", F.col("island").cast("long").alias("island")).agg(F.min("action_type").alias("action_type"), F.count("*").alias("n"), F.min("frame").alias("start"), F.max("frame").alias("end"))


@query(f"""WITH RECURSIVE {TOUCHES}, o AS (SELECT game, frame, speed, row_number() OVER (PARTITION BY game ORDER BY frame, speed) AS n FROM touches),
f AS (SELECT game, n, frame AS kf, speed AS ks, CAST(1 AS BIGINT) AS grp FROM o WHERE n = 1
 UNION ALL SELECT o.game, o.n, CASE WHEN o.frame - f.kf > 3600 OR o.speed > f.ks THEN o.frame ELSE f.kf END, CASE WHEN o.frame - f.kf > 3600 OR o.speed > f.ks THEN o.speed ELSE f.ks END,
 CASE WHEN o.frame - f.kf > 3600 THEN f.grp + 1 ELSE f.grp END FROM f JOIN o ON o.game = f.game AND o.n = f.n + 1)
SELECT game, CAST(arg_max(kf, n) AS DOUBLE) AS frame, round(arg_max(ks, n), 6) AS speed FROM f GROUP BY game, grp""")
def separated_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Greedy de-duplication: the faster of touches within an hour of the last kept one."""
    return ordered.separated(touches(spark, d), ["game"], "frame", "speed", 3600).withColumn("speed", F.round("speed", 6))


@query(f"""WITH {TOUCHES}, t AS (SELECT DISTINCT game, CAST(floor(x / 3) AS BIGINT) AS cell, frame // 3600 AS hour FROM touches),
l AS (SELECT *, lead(hour, 2) OVER (PARTITION BY game, cell ORDER BY hour) AS far FROM t) SELECT DISTINCT game, cell FROM l WHERE far - hour < 6""")
def dense_cells(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).select("game", F.floor(F.col("x") / 3).alias("cell"), F.floor(F.col("frame") / 3600).alias("hour"))
    return ordered.dense_cells(t, ["game", "cell"], "hour", 3, 6)


@query(f"""WITH {TOUCHES}, c AS (SELECT * FROM touches ANTI JOIN (SELECT DISTINCT game, cell FROM (SELECT *, lead(hour, 2) OVER (PARTITION BY game, cell ORDER BY hour) AS far FROM (SELECT DISTINCT game, CAST(floor(x / 3) AS BIGINT) AS cell, frame // 3600 AS hour FROM touches)) WHERE far - hour < 6) h ON touches.game = h.game AND CAST(floor(touches.x / 3) AS BIGINT) = h.cell)
SELECT game, count(*) AS n FROM c GROUP BY game""")
def still_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Touches outside the dense cells, counted by game."""
    t = touches(spark, d).withColumn("cell", F.floor(F.col("x") / 3))
    return t.join(dense_cells(spark, d), ["game", "cell"], "left_anti").groupBy("game").agg(F.count("*").alias("n"))


@query(f"""WITH {TOUCHES} SELECT game, touch_id, max(height) OVER w AS apex FROM touches WINDOW w AS (PARTITION BY game, rally ORDER BY frame, touch_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)""")
def apex_heights(spark: SparkSession, d: str) -> DataFrame:
    """Greatest height from a touch to the next one of its rally."""
    w = Window.partitionBy("game", "rally").orderBy("frame", "touch_id").rowsBetween(0, 1)
    return touches(spark, d).select("game", "touch_id", F.max("height").over(w).alias("apex"))


@query(f"""WITH {TOUCHES} SELECT game, touch_id, round(sqrt(pow(x - lag(x, 3) OVER w, 2) + pow(y - lag(y, 3) OVER w, 2)) / nullif(frame - lag(frame, 3) OVER w, 0), 6) AS trailing FROM touches WINDOW w AS (PARTITION BY game ORDER BY frame, touch_id)""")
def trailing_speed(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("game").orderBy("frame", "touch_id")
    far = scalars.distance(F.lag("x", 3).over(w), F.lag("y", 3).over(w), F.col("x"), F.col("y"))
    return touches(spark, d).select("game", "touch_id", r6(scalars.velocity(far, F.col("frame") - F.lag("frame", 3).over(w)), "trailing"))


@query(f"""WITH {TOUCHES}, h AS (SELECT game, frame // 3600 AS hour, avg(speed) AS v FROM touches GROUP BY game, frame // 3600),
g AS (SELECT game, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY game), d AS (SELECT g.game, g.hour, h.v FROM g LEFT JOIN h USING (game, hour)),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS pt, last_value(v IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN v IS NOT NULL THEN hour END IGNORE NULLS) OVER a AS nt, first_value(v IGNORE NULLS) OVER a AS nv FROM d
 WINDOW b AS (PARTITION BY game ORDER BY hour ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY game ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT game, hour, v IS NULL AND nt - pt - 1 <= 5 AS interpolated, round(CASE WHEN v IS NULL AND nt - pt - 1 <= 5 THEN pv + (hour - pt) / (nt - pt) * (nv - pv) ELSE v END, 6) AS v FROM k""")
def filled_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Hourly mean speeds on a dense grid, short gaps filled by straight lines."""
    h = touches(spark, d).groupBy("game", F.floor(F.col("frame") / 3600).alias("hour")).agg(F.avg("speed").alias("v"))
    grid = h.groupBy("game").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select("game", F.explode(F.sequence("a", "b")).alias("hour"))
    return ordered.interpolated(grid.join(h, ["game", "hour"], "left"), ["game"], "hour", "v", 5).select("game", "hour", "interpolated", r6(F.col("v"), "v"))


@query()
def hermite_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Hourly mean speeds, gaps of up to 20 hours filled by damped cubics."""
    h = touches(spark, d).groupBy("game", F.floor(F.col("frame") / 3600).alias("hour")).agg(F.avg("speed").alias("v"))
    return ordered.hermite_filled(h, ["game"], "hour", "v").select("game", "hour", r6(F.col("v"), "v"), "interpolated")


@query(f"""WITH RECURSIVE {RALLIES}, o AS (SELECT game, greatest(0, start - 3600) AS s, "end" AS e, row_number() OVER (PARTITION BY game ORDER BY greatest(0, start - 3600), "end") AS n FROM rallies WHERE "end" > start),
m AS (SELECT *, max(e) OVER (PARTITION BY game ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
g AS (SELECT *, sum(CASE WHEN s > reach + 10800 THEN 1 ELSE 0 END) OVER (PARTITION BY game ORDER BY n) AS grp FROM m)
SELECT game, min(s) AS start, max(e) AS "end" FROM g GROUP BY game, grp""")
def buffered_windows(spark: SparkSession, d: str) -> DataFrame:
    """Rally windows with an hour of pre-roll, merged where three hours or less apart."""
    return intervals.merged(rallies(spark, d).where(F.col("end") > F.col("start")), ["game"], "start", "end", 3600, 10_800)


@query(f"""WITH {RALLIES}, a AS (SELECT game, rally AS a, start AS s1, "end" AS e1 FROM rallies WHERE n >= 2), b AS (SELECT game, set_index, min(start) AS s2, max("end") AS e2 FROM rallies GROUP BY game, set_index)
SELECT a.game, a.a AS rally, b.set_index, least(e1, e2) - greatest(s1, s2) + 1 AS overlap FROM a JOIN b ON a.game = b.game AND least(e1, e2) >= greatest(s1, s2)""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    r = rallies(spark, d)
    a = r.where("n >= 2").select("game", F.col("rally").cast("long").alias("rally"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = r.groupBy("game", "set_index").agg(F.min("start").alias("s2"), F.max("end").alias("e2"))
    return intervals.overlaps(a, b, ["game"], ("s1", "e1"), ("s2", "e2"), 86_400).select("game", "rally", "set_index", "overlap")


@query(f"""WITH {TOUCHES}, p AS (SELECT game, player, rally // 8 AS part, min(frame) AS s, max(frame) + 1 AS e, count(*) AS strength FROM touches GROUP BY game, player, rally // 8),
m AS (SELECT game, player * 1000 + part AS member, s, e, strength FROM p), b AS (SELECT game, s AS t FROM m UNION SELECT game, e FROM m),
a AS (SELECT game, t, lead(t) OVER (PARTITION BY game ORDER BY t) AS u FROM b), j AS (SELECT a.game, t, u, member, row_number() OVER (PARTITION BY a.game, t ORDER BY strength, member) AS r, count(*) OVER (PARTITION BY a.game, t) AS n FROM a JOIN m ON a.game = m.game AND m.s <= a.t AND m.e >= a.u WHERE u IS NOT NULL)
SELECT game, member, CAST(sum(u - t) AS BIGINT) AS excess FROM j WHERE r <= n - 3 GROUP BY game, member""")
def concurrency_excess(spark: SparkSession, d: str) -> DataFrame:
    """Time that each span is among the weakest when more than three are active."""
    t = touches(spark, d).groupBy("game", "player", F.floor(F.col("rally") / 8).alias("part")).agg(F.min("frame").alias("s"), (F.max("frame") + 1).alias("e"), F.count("*").alias("strength"))
    m = t.select("game", (F.col("player") * 1000 + F.col("part")).alias("member"), "s", "e", "strength")
    return intervals.excess(m, ["game"], "member", "s", "e", "strength", 3)


@query(f"""WITH {RALLIES}, s AS (SELECT game, rally, start, "end" FROM rallies WHERE n >= 4) SELECT a.game, a.rally AS a, b.rally AS b FROM s a JOIN s b ON a.game = b.game AND (b.start > a.start OR (b.start = a.start AND b.rally > a.rally)) AND b.start <= a."end" + 43200""")
def banded_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = rallies(spark, d).where("n >= 4").select("game", F.col("rally").cast("long").alias("rally"), "start", "end")
    return intervals.banded_pairs(s, ["game"], "rally", "start", "end", 43_200)


@query(f"""WITH {TOUCHES}, n AS (SELECT DISTINCT game, frame // 600 AS slot, player FROM touches) SELECT a.game, a.player AS a, b.player AS b, count(*) AS shared, min(a.slot) AS first FROM n a JOIN n b ON a.game = b.game AND a.slot = b.slot AND a.player < b.player GROUP BY ALL""")
def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Players seen in the same ten minutes: pairs, shared slots and the first of them."""
    n = touches(spark, d).select("game", F.floor(F.col("frame") / 600).alias("slot"), "player").distinct()
    a, b = n.withColumnRenamed("player", "a"), n.withColumnRenamed("player", "b")
    return a.join(b, ["game", "slot"]).where("a < b").groupBy("game", "a", "b").agg(F.count("*").alias("shared"), F.min("slot").alias("first"))


@query(f"""WITH {TOUCHES}, q AS (SELECT t.game, t.rally, t.touch_id, o.touch_id AS other, sqrt(pow(o.x - t.x, 2) + pow(o.y - t.y, 2)) AS dist FROM touches t JOIN touches o ON t.game = o.game AND t.rally = o.rally AND t.player <> o.player),
b AS (SELECT game, touch_id, min((dist, other)) AS m FROM q WHERE dist < 2.5 GROUP BY game, touch_id)
SELECT t.game, t.touch_id, struct_extract(b.m, 2) AS near_id, round(struct_extract(b.m, 1), 6) AS near_distance FROM touches t LEFT JOIN b USING (game, touch_id)""")
def nearest_player(spark: SparkSession, d: str) -> DataFrame:
    """The nearest touch of another player in the same rally, inside 2.5 m."""
    t = touches(spark, d)
    r = t.select("game", "rally", F.col("touch_id").alias("other"), F.col("player").alias("p2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = t.join(r, ["game", "rally"]).where("player <> p2").withColumn("_d", scalars.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).where("_d < 2.5")
    best = pairs.groupBy("game", "touch_id").agg(F.min(F.struct("_d", "other")).alias("m"))
    return t.select("game", "touch_id").join(best, ["game", "touch_id"], "left").select("game", "touch_id", F.col("m.other").alias("near_id"), r6(F.col("m._d"), "near_distance"))


@query(f"""WITH {TOUCHES} SELECT t.game, t.touch_id, count(o.touch_id) AS blockers FROM touches t LEFT JOIN touches o ON t.game = o.game AND t.rally = o.rally AND t.player <> o.player AND abs(o.x - 9.0) < 2.5 AND abs(o.y - t.y) <= 1.5 GROUP BY t.game, t.touch_id""")
def blockers(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    o = t.select("game", "rally", F.col("player").alias("p2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = (F.col("player") != F.col("p2")) & (F.abs(F.col("x2") - 9.0) < 2.5) & (F.abs(F.col("y2") - F.col("y")) <= 1.5)
    return spatial.count_within(t, o, ["game", "rally"], "touch_id", near, "blockers").select("game", "touch_id", "blockers")


@query(f"""WITH {TOUCHES} SELECT game, CAST(CASE WHEN x < 9.0 THEN 0 ELSE 6 END + CASE WHEN abs(x - 9.0) < 4.5 THEN 0 ELSE 3 END + greatest(0, least(2, CAST(floor(y / 3.0) AS INT))) AS INT) AS cell, count(*) AS n FROM touches GROUP BY ALL""")
def zone_histogram(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).groupBy("game", scalars.zone_cell(F.col("x"), F.col("y")).alias("cell")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOUCHES}, h AS (SELECT player, action_type, count(*) AS n FROM touches GROUP BY ALL), t AS (SELECT player, sum(n) AS s FROM h GROUP BY player), g AS (SELECT action_type, sum(n) AS n FROM h GROUP BY ALL), z AS (SELECT sum(n) AS s FROM g)
SELECT t.player, round(1 - sum(least(coalesce(h.n, 0) / t.s, g.n / z.s)), 6) AS distance FROM t CROSS JOIN g CROSS JOIN z LEFT JOIN h ON h.player = t.player AND h.action_type = g.action_type GROUP BY t.player""")
def action_mix_distance(spark: SparkSession, d: str) -> DataFrame:
    """Histogram-intersection distance of each player's action mix from everybody's."""
    t = touches(spark, d)
    of = lambda p: [F.count_if(F.col("action_type") == k).alias(p + k) for k in stats.TYPES]
    own, all_ = t.groupBy("player").agg(*of("a_")), t.agg(*of("b_"))
    distance = stats.histogram_distance({k: F.col("a_" + k) for k in stats.TYPES}, {k: F.col("b_" + k) for k in stats.TYPES})
    return own.join(F.broadcast(all_)).select("player", r6(distance, "distance"))


@query(f"""WITH {TOUCHES}, c AS (SELECT game, action_type, count(*) AS n, min((frame, touch_id)) AS first FROM touches GROUP BY ALL) SELECT game, arg_min(action_type, row(-n, first)) AS mode FROM c GROUP BY game""")
def first_mode(spark: SparkSession, d: str) -> DataFrame:
    return stats.mode_first(touches(spark, d), ["game"], "action_type", ["frame", "touch_id"])


@query(f"""WITH {TOUCHES}, t AS (SELECT player, count(*) AS n FROM touches GROUP BY player) SELECT player, n FROM t ORDER BY n DESC, player LIMIT 6""")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """The six players of most touches."""
    return touches(spark, d).groupBy("player").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "player").limit(6)


@query(f"""WITH {TOUCHES}, t AS (SELECT game, player, count(*) AS n FROM touches GROUP BY ALL) SELECT game, player, n FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY n DESC, player) AS r FROM t) WHERE r <= 3""")
def game_leaders(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).groupBy("game", "player").agg(F.count("*").alias("n"))
    return stats.top_n(t, ["game"], [F.desc("n"), "player"], 3)


@query(f"""WITH {TOUCHES} SELECT game, touch_id FROM (SELECT game, touch_id, row_number() OVER (PARTITION BY game ORDER BY frame, touch_id) - 1 AS n FROM touches) WHERE n % 5 = 0""")
def decimated(spark: SparkSession, d: str) -> DataFrame:
    return ordered.every_kth(touches(spark, d), ["game"], ["frame", "touch_id"], 5).select("game", "touch_id")


@query(f"""WITH {TOUCHES}, n AS (SELECT game, touch_id, row_number() OVER (PARTITION BY game ORDER BY frame, touch_id) - 1 AS n, count(*) OVER (PARTITION BY game) AS c FROM touches)
SELECT game, touch_id FROM n WHERE c <= 7 OR list_contains([CAST(round_even(i * (c - 1) / 6.0, 0) AS BIGINT) FOR i IN range(7)], n)""")
def evenly_sampled(spark: SparkSession, d: str) -> DataFrame:
    return ordered.evenly_spaced(touches(spark, d), ["game"], ["frame", "touch_id"], 7).select("game", "touch_id")


@query(f"""WITH {TOUCHES} SELECT game, touch_id, ((row_number() OVER (PARTITION BY game ORDER BY frame, touch_id) - 1) % 5) = 2 AS held_out FROM touches""")
def modulo_split(spark: SparkSession, d: str) -> DataFrame:
    return upserts.held_out(touches(spark, d), ["game"], ["frame", "touch_id"]).select("game", "touch_id", "held_out")


@query(f"""WITH {TOUCHES} SELECT game, round(regr_slope(speed, frame / 86400.0), 6) AS slope, round(avg(speed), 6) AS mean FROM touches GROUP BY game""")
def speed_trend(spark: SparkSession, d: str) -> DataFrame:
    _, slope = stats.fit_line(F.col("frame") / 86400.0, F.col("speed"))
    return touches(spark, d).groupBy("game").agg(r6(slope, "slope"), r6(F.avg("speed"), "mean"))


@query(f"""WITH {TOUCHES} SELECT game, rally, round(regr_intercept(height + 4.905 * t * t, t), 4) AS z0, round(regr_slope(height + 4.905 * t * t, t), 4) AS v0 FROM (SELECT game, rally, height, (frame - min(frame) OVER (PARTITION BY game, rally)) / 3600.0 AS t FROM touches) GROUP BY game, rally HAVING count(height) >= 3 AND count(DISTINCT CASE WHEN height IS NOT NULL THEN t END) >= 3""")
def flight_fits(spark: SparkSession, d: str) -> DataFrame:
    """Gravity-constrained fits of heights over a rally."""
    t = touches(spark, d).withColumn("t", (F.col("frame") - F.min("frame").over(Window.partitionBy("game", "rally"))) / 3600.0)
    z0, v0 = stats.fit_fall(F.col("t"), F.col("height"))
    out = t.groupBy("game", F.col("rally").cast("long").alias("rally")).agg(F.round(z0, 4).alias("z0"), F.round(v0, 4).alias("v0"), F.count("height").alias("n"), F.countDistinct(F.when(F.col("height").isNotNull(), F.col("t"))).alias("k"))
    return out.where("n >= 3 and k >= 3").drop("n", "k")


@query(f"""WITH {TOUCHES}, b AS (SELECT touch_id, game, x, y, frame, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM touches WINDOW w AS (PARTITION BY game, rally ORDER BY frame, touch_id))
SELECT game, touch_id, round(degrees(acos(greatest(-1.0, least(1.0, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))), 5) AS angle FROM b WHERE sqrt(ux * ux + uy * uy) >= 1e-6 AND sqrt(vx * vx + vy * vy) >= 1e-6""")
def turn_angles(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("game", "rally").orderBy("frame", "touch_id")
    t = touches(spark, d).withColumns({"ux": F.col("x") - F.lag("x").over(w), "uy": F.col("y") - F.lag("y").over(w), "vx": F.lead("x").over(w) - F.col("x"), "vy": F.lead("y").over(w) - F.col("y")})
    return t.select("game", "touch_id", F.round(scalars.angle(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")), 5).alias("angle")).where("angle is not null")


@query(f"""WITH {TOUCHES}, s AS (SELECT game, frame // 3600 AS hour, count(*) AS n, avg(x) AS x, avg(y) AS y FROM touches GROUP BY ALL), g AS (SELECT game, unnest(range(min(hour), max(hour) + 1)) AS hour FROM s GROUP BY game), f AS (SELECT g.game, g.hour, s.n IS NOT NULL AS seen, x, y FROM g LEFT JOIN s USING (game, hour)),
l AS (SELECT *, coalesce(lag(seen) OVER w, true) AS before, CASE WHEN seen AND lag(seen) OVER w THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) END AS step FROM f WINDOW w AS (PARTITION BY game ORDER BY hour)),
o AS (SELECT *, sum(CASE WHEN NOT seen AND before THEN 1 ELSE 0 END) OVER (PARTITION BY game ORDER BY hour) AS gap FROM l), m AS (SELECT game, max(n) AS max_gap FROM (SELECT game, gap, count(*) AS n FROM o WHERE NOT seen GROUP BY ALL) GROUP BY game)
SELECT o.game, round(avg(CASE WHEN seen THEN 1.0 ELSE 0.0 END), 6) AS rate, CAST(sum(CASE WHEN NOT seen AND before THEN 1 ELSE 0 END) AS BIGINT) AS gaps, coalesce(any_value(m.max_gap), 0) AS max_gap, round(avg(step), 6) AS jitter FROM o LEFT JOIN m USING (game) GROUP BY o.game""")
def detection_quality(spark: SparkSession, d: str) -> DataFrame:
    """Hours with touches as detections: rate, gaps, longest gap and jitter."""
    s = touches(spark, d).groupBy("game", F.floor(F.col("frame") / 3600).alias("hour")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    grid = s.groupBy("game").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select("game", F.explode(F.sequence("a", "b")).alias("hour"))
    out = stats.detection_quality(grid.join(s, ["game", "hour"], "left"), ["game"], "hour", F.col("n").isNotNull(), "x", "y")
    return out.select("game", r6(F.col("rate"), "rate"), "gaps", "max_gap", r6(F.col("jitter"), "jitter"))


@query(f"""WITH {RALLIES} SELECT game, count(*) AS rallies, round(avg("end" - start), 6) AS mean_duration, round(median("end" - start), 6) AS median_duration FROM rallies GROUP BY game""")
def rally_durations(spark: SparkSession, d: str) -> DataFrame:
    length = F.col("end") - F.col("start")
    return rallies(spark, d).groupBy("game").agg(F.count("*").alias("rallies"), r6(F.avg(length), "mean_duration"), r6(F.median(length), "median_duration"))


@query(f"""WITH {RALLIES}, w AS (SELECT game, set_index, CASE WHEN count(*) % 3 = 0 THEN NULL WHEN count(*) FILTER (start_side = 'A') > count(*) FILTER (start_side = 'B') THEN 'A' ELSE 'B' END AS team FROM rallies GROUP BY game, set_index),
f AS (SELECT game, min((set_index, team)) FILTER (team IS NOT NULL) AS first FROM w GROUP BY game)
SELECT game, set_index, coalesce(team, CASE WHEN abs(set_index - struct_extract(first, 1)) % 2 = 0 THEN struct_extract(first, 2) WHEN struct_extract(first, 2) = 'A' THEN 'B' WHEN struct_extract(first, 2) = 'B' THEN 'A' END) AS team FROM w JOIN f USING (game)""")
def alternated_sides(spark: SparkSession, d: str) -> DataFrame:
    """Sides by set, sets without a clear one filled by alternation."""
    a, b = F.count_if(F.col("start_side") == "A"), F.count_if(F.col("start_side") == "B")
    w = rallies(spark, d).groupBy("game", "set_index").agg(F.when(F.count("*") % 3 == 0, None).when(a > b, "A").otherwise("B").alias("team"))
    return ordered.alternation(w, ["game"], "set_index", "team", {"A": "B", "B": "A"})


@query(f"""WITH {_WON} SELECT game, rally, CAST(coalesce(sum(CASE WHEN winner = 'A' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS a, CAST(coalesce(sum(CASE WHEN winner = 'B' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS b FROM won WINDOW w AS (PARTITION BY game, set_index ORDER BY rally ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of the set before each rally."""
    w = Window.partitionBy("game", "set_index").orderBy("rally").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda s: F.coalesce(F.sum((F.col("winner") == s).cast("long")).over(w), F.lit(0))
    return _won(spark, d).select("game", F.col("rally").cast("long").alias("rally"), n("A").alias("a"), n("B").alias("b"))


@query(f"""WITH {_WON}, s AS (SELECT game, max(rally) // 2 AS lo, max(rally) AS hi FROM won GROUP BY game)
SELECT game, rally, CASE WHEN rally BETWEEN lo AND hi THEN CASE winner WHEN 'A' THEN 'B' ELSE 'A' END ELSE winner END AS winner FROM won JOIN s USING (game)""")
def range_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Winners with those of each game's second half replaced by their opposites."""
    base = _won(spark, d).select("game", F.col("rally").cast("long").alias("rally"), "winner")
    scope = base.groupBy("game").agg(F.floor(F.max("rally") / 2).alias("lo"), F.max("rally").alias("hi"))
    fresh = base.withColumn("winner", F.when(F.col("winner") == "A", "B").otherwise("A"))
    return upserts.range_replaced(base, fresh, scope, "game", "rally")
