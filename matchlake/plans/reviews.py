"""Court ranges, gates, trims, sorts and members on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import scalars
from matchlake.operators import asof, detection, intervals, members, ordered, ranks, spatial, stats, upserts
from matchlake.params import Params
from matchlake.plans.bindings import RALLIES, TOUCHES, rallies, table, touches
from matchlake.plans.tracking import _COUNTS, _WON, _won

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


@query("""WITH p AS (SELECT l_orderkey AS game, l_linenumber AS line, l_quantity - 15 AS x, l_discount * 150 - 2 AS y, l_returnflag <> 'N' AS calibrated FROM lineitem)
SELECT game, line, count(*) AS n, bool_and(NOT calibrated OR (x BETWEEN -6 AND 24 AND y BETWEEN 0 AND 9)) AS in_play, bool_and(x BETWEEN -5 AND 23 AND y BETWEEN -1.5 AND 10.5) AS in_range FROM p GROUP BY ALL""")
def court_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Places inside the play area and inside the court's surroundings."""
    x, y = F.col("l_quantity") - 15, F.col("l_discount") * 150 - 2
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("line"), scalars.in_play_area(x, y, F.col("l_returnflag") != "N").alias("a"), scalars.in_court_range(x, y).alias("r"))
    return p.groupBy("game", "line").agg(F.count("*").alias("n"), F.bool_and("a").alias("in_play"), F.bool_and("r").alias("in_range"))


@query(f"""WITH {TOUCHES}, points AS (SELECT game, frame // 600 AS t, avg(x) AS x, avg(y) AS y FROM touches WHERE touch_id % 5 <> 0 AND height IS NOT NULL GROUP BY game, frame // 600),
n AS (SELECT game, t, x, y, last_value(t) OVER b AS bt, last_value(x) OVER b AS bx, last_value(y) OVER b AS b_y, first_value(t) OVER a AS a_t, first_value(x) OVER a AS ax, first_value(y) OVER a AS ay FROM points
 WINDOW b AS (PARTITION BY game ORDER BY t RANGE BETWEEN 40 PRECEDING AND 5 PRECEDING), a AS (PARTITION BY game ORDER BY t RANGE BETWEEN 5 FOLLOWING AND 40 FOLLOWING)),
v AS (SELECT game, t, x - bx AS ux, y - b_y AS uy, ax - x AS vx, ay - y AS vy, t - bt AS din, a_t - t AS dout FROM n WHERE bt IS NOT NULL AND a_t IS NOT NULL),
s AS (SELECT game, t, CASE WHEN sqrt(ux*ux+uy*uy) >= 1e-6 AND sqrt(vx*vx+vy*vy) >= 1e-6 THEN degrees(acos(greatest(-1.0, least(1.0, (ux*vx+uy*vy) / (sqrt(ux*ux+uy*uy) * sqrt(vx*vx+vy*vy)))))) END AS turn, sqrt(ux*ux+uy*uy) / din AS speed_in, sqrt(vx*vx+vy*vy) / dout AS speed_out FROM v)
SELECT game, t, round(turn, 5) AS turn FROM s WHERE turn >= 40 OR speed_in <= 1e-6 OR greatest(speed_in, speed_out) / speed_in >= 1.6""")
def measured_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits from measured points only: interpolated ones and those without a pixel are left out."""
    real = touches(spark, d).where(scalars.measured(F.col("touch_id") % 5 == 0, F.col("height")))
    points = real.groupBy("game", F.floor(F.col("frame") / 600).alias("t")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return detection.hits(points, ["game"], "t", "x", "y", 5, 40).select("game", "t", F.round("turn", 5).alias("turn"))


@query(f"""WITH {TOUCHES}, s AS (SELECT game, player, count(*) AS hits FROM touches GROUP BY ALL), names AS (SELECT DISTINCT game, player, CASE WHEN player % 4 = 1 THEN '  ' ELSE ' p' || CAST(player AS VARCHAR) || ' ' END AS name FROM touches WHERE player % 3 <> 0)
SELECT s.game, s.player, hits, CASE WHEN trim(name) <> '' THEN trim(name) END AS name FROM s LEFT JOIN names USING (game, player)""")
def named_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics with names laid over whatever name they had."""
    t = touches(spark, d)
    names = t.where("player % 3 <> 0").select("game", "player", F.when(F.col("player") % 4 == 1, "  ").otherwise(F.concat(F.lit(" p"), F.col("player").cast("string"), F.lit(" "))).alias("name")).distinct()
    own = t.groupBy("game", "player").agg(F.count("*").alias("hits")).withColumn("name", F.lit("old"))
    return members.with_names(own, names, ["game", "player"])


@query("""SELECT trim(c_mktsegment) AS name, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_nationkey, c_custkey) AS thumbnails FROM customer WHERE c_custkey % 3 = 0 AND trim(c_mktsegment) <> '' GROUP BY ALL""")
def thumbnails_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Each name's thumbnails, where a player has one, by game and id."""
    rows = table(spark, d, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("name"), "c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).alias("thumbnail"))
    return members.listed_by_name(rows, "name", "thumbnail", ["c_nationkey", "c_custkey"]).select("name", F.array_join("values", ",").alias("thumbnails"))


@query(f"""WITH {_WON}, w AS (SELECT w.game, w.set_index, CASE WHEN r.n >= 2 THEN winner END AS winner FROM won w JOIN rallies r ON w.game = r.game AND w.rally = r.rally)
SELECT game, set_index, count(*) FILTER (winner IS NULL) AS uncertain, bool_and(winner IS NULL) AS unread, count(*) FILTER (winner IS NULL) = 0 AS confirmable FROM w GROUP BY ALL""")
def set_gates(spark: SparkSession, d: str) -> DataFrame:
    """Of each set: rallies without a winner, whether all are, and whether the set can be confirmed. Rallies of one touch have no winner."""
    n = rallies(spark, d).select("game", "rally", "n")
    w = _won(spark, d).select("game", "rally", "set_index", "winner").join(n, ["game", "rally"]).withColumn("winner", F.when(F.col("n") >= 2, F.col("winner")))
    none = F.col("winner").isNull()
    return w.groupBy("game", "set_index").agg(F.count_if(none).alias("uncertain"), F.bool_and(none).alias("unread"), (F.count_if(none) == 0).alias("confirmable"))


def _placed(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """df with places from 1 in the order of the whole table."""
    return ranks.ranked(df, *order, name=name).withColumn(name, F.col(name) + 1)


@query("""SELECT n_nationkey AS profile, row_number() OVER (ORDER BY n_nationkey <> 6, lower(n_name), n_nationkey) AS place FROM nation""")
def profiles_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The default profile first, then by name."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("profile"), F.lower("n_name").alias("low"))
    return _placed(rows, F.col("profile") != 6, "low", "profile").drop("low")


@query("""WITH t AS (SELECT n_nationkey AS team, n_name AS name, count(c_custkey) AS size FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT team, size, row_number() OVER (ORDER BY name, team) AS by_name, row_number() OVER (ORDER BY size DESC, name, team) AS by_size FROM t""")
def teams_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Teams by name and by roster size."""
    size = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("team")).agg(F.count("*").alias("n"))
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("name")).join(size, "team", "left").withColumn("size", F.coalesce("n", F.lit(0)).cast("long"))
    by_name = _placed(t.select("team", "name", "size"), "name", "team", name="by_name")
    return _placed(by_name, F.desc("size"), "name", "team", name="by_size").select("team", "size", "by_name", "by_size")


@query("""WITH g AS (SELECT o_custkey AS player, o_orderkey AS game, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders) SELECT player, game, day, row_number() OVER (PARTITION BY player ORDER BY coalesce(day, '') DESC, game) AS place FROM g""")
def profile_games(spark: SparkSession, d: str) -> DataFrame:
    """A player's games from the latest day on; those without a day last."""
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("game"), F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    w = Window.partitionBy("player").orderBy(F.desc(F.coalesce("day", F.lit(""))), "game")
    return g.withColumn("place", F.row_number().over(w).cast("long"))


@query("""WITH g AS (SELECT l_suppkey % 40 AS game, l_returnflag || l_linestatus AS grp, count(*) AS size, min(l_tax) AS confidence FROM lineitem GROUP BY ALL) SELECT game, grp, size, row_number() OVER (PARTITION BY game ORDER BY size DESC, confidence DESC, grp) AS place FROM g""")
def groups_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Groups of a game from the largest and surest on."""
    g = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("game"), F.concat("l_returnflag", "l_linestatus").alias("grp")).agg(F.count("*").alias("size"), F.min("l_tax").alias("c"))
    return g.select("game", "grp", "size", F.row_number().over(Window.partitionBy("game").orderBy(F.desc("size"), F.desc("c"), "grp")).cast("long").alias("place"))


@query(f"""WITH {TOUCHES}, s AS (SELECT game, player, count(*) AS hits, count(DISTINCT rally) AS rallies FROM touches GROUP BY ALL)
SELECT game, player, row_number() OVER (PARTITION BY game ORDER BY hits DESC, player) AS most_hits, row_number() OVER (PARTITION BY game ORDER BY hits, player) AS fewest_hits, row_number() OVER (PARTITION BY game ORDER BY rallies DESC, player) AS most_rallies, row_number() OVER (PARTITION BY game ORDER BY player DESC) AS by_id FROM s""")
def roster_sorts(spark: SparkSession, d: str) -> DataFrame:
    """A game's roster by hits, rallies and id, either way."""
    s = touches(spark, d).groupBy("game", "player").agg(F.count("*").alias("hits"), F.countDistinct("rally").alias("rallies"))
    place = lambda *order: F.row_number().over(Window.partitionBy("game").orderBy(*order)).cast("long")
    return s.select("game", "player", place(F.desc("hits"), "player").alias("most_hits"), place("hits", "player").alias("fewest_hits"), place(F.desc("rallies"), "player").alias("most_rallies"), place(F.desc("player")).alias("by_id"))


@query("""WITH m AS (SELECT l_suppkey % 20 AS model, avg(CASE WHEN l_returnflag = 'R' AND l_suppkey % 20 < 15 THEN l_discount END) AS score FROM lineitem GROUP BY ALL) SELECT model, round(score, 6) AS score, row_number() OVER (ORDER BY coalesce(round(score, 9), -1) DESC, model) AS place FROM m""")
def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Models by score; those without one count as -1."""
    m = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("model")).agg(F.avg(F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 20 < 15), F.col("l_discount"))).alias("s"))
    return _placed(m, F.desc(F.coalesce(F.round("s", 9), F.lit(-1.0))), "model").select("model", r6(F.col("s"), "score"), "place")


@query("""SELECT l_suppkey % 20 AS clip, l_orderkey AS frame, l_linenumber AS line, abs(l_quantity - 25) AS error FROM lineitem QUALIFY row_number() OVER (PARTITION BY clip ORDER BY error DESC, frame, line, l_partkey) <= 15""")
def worst_errors(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen worst frames of each clip."""
    e = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("clip"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("line"), F.abs(F.col("l_quantity") - 25).alias("error"), "l_partkey")
    return stats.top_n(e, ["clip"], [F.desc("error"), "frame", "line", "l_partkey"], 15).drop("l_partkey")


@query(f"""WITH {TOUCHES}, o AS (SELECT game, player FROM touches GROUP BY ALL HAVING avg(CASE WHEN x BETWEEN 1.0 AND 17.0 AND y BETWEEN 0 AND 8 THEN 1.0 ELSE 0.0 END) < 0.85), i AS (SELECT DISTINCT game, player FROM touches WHERE player % 7 = 3)
SELECT game, player, false AS newly FROM i UNION ALL SELECT game, player, true FROM (SELECT * FROM o EXCEPT SELECT * FROM i)""")
def ignored_changes(spark: SparkSession, d: str) -> DataFrame:
    """Ignored players after those mostly outside the court were added."""
    t = touches(spark, d)
    inside = F.col("x").between(1.0, 17.0) & F.col("y").between(0, 8)
    out = t.groupBy("game", "player").agg(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("s")).where("s < 0.85")
    return members.ignored_changes(out, t.where("player % 7 = 3"), ["game", "player"])


@query(f"""WITH {TOUCHES}, f AS (SELECT DISTINCT game, player, frame // 3600 AS hour FROM touches) SELECT a.game, a.player AS a, b.player AS b, count(*) AS shared FROM f a JOIN f b ON a.game = b.game AND a.hour = b.hour AND a.player < b.player GROUP BY ALL""")
def shared_frames(spark: SparkSession, d: str) -> DataFrame:
    """Hours in which two players of a game both touched the ball."""
    return members.shared_frames(touches(spark, d).withColumn("hour", F.floor(F.col("frame") / 3600)), ["game"], "player", "hour")


_HOURS = "f AS (SELECT DISTINCT game, player, frame // 3600 AS hour FROM touches)"
_KIMS = "CASE player % 4 WHEN 0 THEN 'Kim' WHEN 1 THEN ' Kim ' WHEN 2 THEN 'kim' ELSE 'kim ' END"


def _kims():
    return F.when(F.col("player") % 4 == 0, "Kim").when(F.col("player") % 4 == 1, " Kim ").when(F.col("player") % 4 == 2, "kim").otherwise("kim ")


@query(f"""WITH {TOUCHES}, {_HOURS}, n AS (SELECT *, trim({_KIMS}) AS name FROM f WHERE player % 7 <> 3)
SELECT a.game, a.player AS a, b.player AS b, a.name, count(*) AS shared, min(a.hour) AS first_frame, round(min(a.hour) / 8.0, 1) AS first_time FROM n a JOIN n b ON a.game = b.game AND a.hour = b.hour AND a.name = b.name AND a.player < b.player GROUP BY ALL""")
def name_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Players of one name who touched the ball in the same hour; ignored ones don't count."""
    t = touches(spark, d).withColumn("hour", F.floor(F.col("frame") / 3600)).withColumn("time", F.col("hour") / 8.0)
    ids = t.select("game", "player").distinct()
    return members.name_conflicts(t, ids.withColumn("name", _kims()), ids.where("player % 7 = 3"), ["game"], "player", "hour", time="time")


_GUARD = f"""{TOUCHES}, {_HOURS}, ids AS (SELECT DISTINCT game, player FROM touches), base AS (SELECT game, player, {_KIMS} AS name FROM ids WHERE player % 3 = 0), ch AS (SELECT game, player, CASE WHEN player % 2 = 0 THEN 'kim' ELSE 'p' || CAST(player AS VARCHAR) END AS name FROM ids WHERE player % 5 = 1 OR player % 11 = 0),
merged AS (SELECT * FROM base ANTI JOIN ch USING (game, player) UNION ALL SELECT * FROM ch), n AS (SELECT game, player, trim(name) AS name FROM merged WHERE player % 7 <> 3),
bad AS (SELECT x.game, x.player AS a, y.player AS b, x.name, count(*) AS shared, min(x.hour) AS first_frame FROM (SELECT * FROM f JOIN n USING (game, player)) x JOIN (SELECT * FROM f JOIN n USING (game, player)) y ON x.game = y.game AND x.hour = y.hour AND x.name = y.name AND x.player < y.player GROUP BY ALL),
refused AS (SELECT * FROM bad WHERE EXISTS (SELECT 1 FROM ch WHERE ch.game = bad.game AND ch.player IN (bad.a, bad.b)))"""


def _guarded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = touches(spark, d).withColumn("hour", F.floor(F.col("frame") / 3600))
    ids = t.select("game", "player").distinct()
    changes = ids.where("player % 5 = 1 or player % 11 = 0").withColumn("name", F.when(F.col("player") % 2 == 0, "kim").otherwise(F.concat(F.lit("p"), F.col("player").cast("string"))))
    return members.names_checked(t, ids.where("player % 3 = 0").withColumn("name", _kims()), changes, ids.where("player % 7 = 3"), ["game"], "player", "hour")


@query(f"WITH {_GUARD} SELECT * FROM refused")
def refused_names(spark: SparkSession, d: str) -> DataFrame:
    """Namings that would give one name to two players seen in the same hour."""
    return _guarded(spark, d)[1]


@query(f"WITH {_GUARD}, k AS (SELECT * FROM ch WHERE game NOT IN (SELECT game FROM refused)) SELECT * FROM base ANTI JOIN k USING (game, player) UNION ALL SELECT * FROM k")
def names_after_check(spark: SparkSession, d: str) -> DataFrame:
    """Names after the changes of the games in which none was refused."""
    return _guarded(spark, d)[0]


_BOX = "box AS (SELECT l_orderkey AS game, l_partkey AS id, l_suppkey AS player, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 1 + l_tax * 100 AS x2, l_discount * 100 + 5 AS y2 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) = 1)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """One box per order and part."""
    c = F.col
    w = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey")
    rows = table(spark, d, "lineitem").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.select(c("l_orderkey").alias("game"), c("l_partkey").alias("id"), c("l_suppkey").alias("player"), c("l_quantity").alias("x1"), (c("l_discount") * 100).alias("y1"), (c("l_quantity") + 1 + c("l_tax") * 100).alias("x2"), (c("l_discount") * 100 + 5).alias("y2"))


_ISOLATED = f"{_BOX}, gaps AS (SELECT a.game, a.id, min(abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2)) AS g FROM box a JOIN box b ON a.game = b.game AND a.id <> b.id GROUP BY ALL), iso AS (SELECT box.*, g / greatest(1.0, x2 - x1) AS gap, coalesce(round_even(g / greatest(1.0, x2 - x1) / 0.25, 0), 99.0) AS isolation FROM box LEFT JOIN gaps USING (game, id))"


@query(f"WITH {_ISOLATED} SELECT game, id, round(gap, 6) AS gap, isolation FROM iso")
def isolation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Free room beside each box of a frame."""
    return members.isolation(_boxes(spark, d), ["game"], "id", "x1", "x2").select("game", "id", r6(F.col("gap"), "gap"), "isolation")


@query(f"""WITH {_BOX}, p AS (SELECT game, id, x1 - 0.18 * (x2 - x1) AS x1, y1 - 0.18 * (y2 - y1) AS y1, x2 + 0.18 * (x2 - x1) AS x2, y2 + 0.18 * (y2 - y1) AS y2 FROM box)
SELECT game, id FROM p a WHERE EXISTS (SELECT 1 FROM box b WHERE a.game = b.game AND a.id <> b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)""")
def padded_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that come too close to another one."""
    return members.conflicts(_boxes(spark, d), ["game"], "id", ("x1", "y1", "x2", "y2")).select("game", "id")


@query(f"""WITH {_ISOLATED} SELECT player, game, id, isolation FROM iso QUALIFY row_number() OVER (PARTITION BY player ORDER BY isolation DESC, (x2 - x1) * (y2 - y1) DESC, game, id) = 1""")
def best_crops(spark: SparkSession, d: str) -> DataFrame:
    """Each player's box with the most room, then the largest."""
    rows = members.isolation(_boxes(spark, d), ["game"], "id", "x1", "x2")
    area = scalars.box_area(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return members.best_crops(rows, [], "player", "isolation", area, ["game", "id"]).select("player", "game", "id", "isolation")


@query(f"""WITH {TOUCHES} SELECT game, touch_id, CASE WHEN speed * 2 <= 45 THEN round(speed * 2, 6) END AS speed FROM touches""")
def plausible_speeds(spark: SparkSession, d: str) -> DataFrame:
    """Speeds that a ball can have."""
    return touches(spark, d).select("game", "touch_id", r6(scalars.plausible_speed(F.col("speed") * 2), "speed"))


@query(f"""WITH {TOUCHES}, h AS (SELECT game, frame, touch_id, height FROM touches WHERE height IS NOT NULL) SELECT t.game, t.touch_id, h.height AS height, t.frame - h.frame AS age FROM (SELECT * FROM touches WHERE action_type = 'spike') t ASOF LEFT JOIN h ON t.game = h.game AND t.frame >= h.frame""")
def height_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The latest known height of the ball at each spike."""
    t = touches(spark, d)
    known = t.where("height is not null").groupBy("game", "frame").agg(F.max_by("height", "touch_id").alias("height"))
    out = asof.backward(t.where("action_type = 'spike'"), known.select("game", F.col("frame").alias("at"), F.col("height").alias("h")), ["game"], "frame", "at", ["h"])
    return out.select("game", "touch_id", F.col("asof_h").alias("height"), (F.col("frame") - F.col("asof_time")).alias("age"))


@query(f"""WITH {TOUCHES}, e AS (SELECT DISTINCT game, frame // 600 AS f FROM touches), w AS (SELECT game, (min(frame) + 86400) / 60.0 AS lo, (max(frame) - 86400) / 60.0 AS hi FROM touches GROUP BY game)
SELECT e.game, row_number() OVER (PARTITION BY e.game ORDER BY f) - 1 AS frame, round(f / 0.1 - lo, 6) AS time FROM e JOIN w ON e.game = w.game WHERE f / 0.1 BETWEEN lo AND hi""")
def dense_rebased(spark: SparkSession, d: str) -> DataFrame:
    """A dense log of ten-minute frames, trimmed by a day on both sides and renumbered."""
    t = touches(spark, d)
    w = t.groupBy("game").agg(((F.min("frame") + 86_400) / 60.0).alias("lo"), ((F.max("frame") - 86_400) / 60.0).alias("hi"))
    e = t.select("game", F.floor(F.col("frame") / 600).alias("frame")).distinct().join(w, "game")
    out = intervals.dense_rebased(e, ["game"], "frame", 0.1, F.col("lo"), F.col("hi"))
    return out.select("game", F.col("frame").cast("long").alias("frame"), r6(F.col("time"), "time"))


@query("""SELECT o_orderkey AS game, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 END, 0) AS start, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 2 END, -1) AS "end", o_orderstatus = 'P' AS endless FROM orders""")
def effective_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Trim ranges of games from what their settings leave open; -1 stands for no end."""
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    start, end = scalars.effective_range(F.when(s == "F", p / 1000), F.when(s == "O", p), F.when(s != "P", p * 2))
    endless = end == float("inf")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("game"), start.alias("start"), F.when(endless, -1.0).otherwise(end).alias("end"), endless.alias("endless"))


@query("""WITH p AS (SELECT l_suppkey % 20 AS clip, l_discount * 10 AS c, l_tax * 3 AS o, l_quantity * 2 AS s FROM lineitem) SELECT clip, count(*) FILTER (c >= 0.6) AS selected, count(*) FILTER (c >= 0.6 AND o >= 0.1) AS detected, count(*) FILTER (s >= 40) AS read FROM p GROUP BY clip""")
def confidence_gates(spark: SparkSession, d: str) -> DataFrame:
    """How many rows pass the gates of the ball, of detected actions and of read scores."""
    c, o = F.col("l_discount") * 10, F.col("l_tax") * 3
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("clip")).agg(F.count_if(c >= Params().get("ball_detection", "MIN_SELECT_CONFIDENCE")).alias("selected"), F.count_if(scalars.sure_action(c, o, Params().get("action_detection", "ACTION_DETECTOR_CONFIDENCE_THRESHOLD"))).alias("detected"), F.count_if(F.col("l_quantity") * 2 >= 40).alias("read"))


@query(f"""WITH {_WON}, s AS (SELECT game, set_index, min(rally) AS first FROM rallies GROUP BY ALL) SELECT s.game, s.set_index, count(w.rally) AS rallies, count(*) FILTER (winner = 'A') AS won_a, count(*) FILTER (winner = 'B') AS won_b FROM s LEFT JOIN won w ON s.game = w.game AND s.set_index = w.set_index GROUP BY ALL""")
def set_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each set with its rallies and their winners."""
    sets = rallies(spark, d).groupBy("game", "set_index").agg(F.min("rally").alias("first"))
    w = _won(spark, d).select("game", "set_index", "rally", "winner")
    return sets.join(w, ["game", "set_index"], "left").groupBy("game", "set_index").agg(F.count("rally").alias("rallies"), F.count_if(F.col("winner") == "A").alias("won_a"), F.count_if(F.col("winner") == "B").alias("won_b"))


@query(f"""WITH {RALLIES}, p AS (SELECT game, rally, row_number() OVER (PARTITION BY game ORDER BY rally) - 1 AS pos, count(*) OVER (PARTITION BY game) AS n FROM rallies WHERE n >= 2),
s AS (SELECT g.game, k AS set_index, k * 7 AS lo, k * 7 + 8 AS hi FROM (SELECT DISTINCT game FROM rallies) g, (SELECT unnest(range(0, 40)) AS k) x) SELECT s.game, set_index, pos AS position, rally FROM s JOIN p ON s.game = p.game AND pos BETWEEN lo AND least(hi, n - 1)""")
def rallies_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Rallies of sets that are bounded by positions; bounds go beyond the last rally."""
    r = rallies(spark, d).where("n >= 2").select("game", F.col("rally").cast("long").alias("rally"))
    s = rallies(spark, d).select("game").distinct().withColumn("set_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))).withColumns({"lo": F.col("set_index") * 7, "hi": F.col("set_index") * 7 + 8})
    return intervals.by_position(s, r, ["game"], ["rally"], "lo", "hi").select("game", "set_index", F.col("position").cast("long").alias("position"), "rally")


@query(f"""WITH {TOUCHES}, p AS (SELECT DISTINCT game, frame // 600 AS f FROM touches WHERE action_type = 'set'), q AS (SELECT DISTINCT game, frame // 600 AS f FROM touches WHERE action_type = 'dig')
SELECT q.game, q.f AS frame, arg_min(p.f, abs(p.f - q.f) * 2 + CASE WHEN p.f > q.f THEN 1 ELSE 0 END) AS near FROM q LEFT JOIN p ON p.game = q.game AND abs(p.f - q.f) <= 5 GROUP BY ALL""")
def players_near(spark: SparkSession, d: str) -> DataFrame:
    """For each frame with a dig the nearest one with a set, at most five away; of two as near the earlier."""
    f = touches(spark, d).select("game", F.floor(F.col("frame") / 600).alias("frame"), "action_type")
    sets = f.where("action_type = 'set'").select("game", F.col("frame").alias("f")).distinct()
    out = asof.nearest(f.where("action_type = 'dig'").select("game", "frame").distinct(), sets, ["game"], "frame", "f", [], within=5)
    return out.select("game", "frame", F.col("asof_time").alias("near"))


@query(f"""WITH {TOUCHES}, {"b AS (SELECT game, min(frame) AS start FROM touches GROUP BY game, rally)"} SELECT t.game, t.touch_id, CASE WHEN min(abs(b.start - t.frame)) <= 1800 THEN min(abs(b.start - t.frame)) END AS distance FROM touches t JOIN b ON b.game = t.game GROUP BY ALL""")
def nearest_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    """How far the nearest start of a rally is, if within half an hour."""
    t = touches(spark, d)
    b = t.groupBy("game", "rally").agg(F.min("frame").alias("start")).select("game", "start").distinct()
    out = asof.nearest(t.select("game", "touch_id", "frame"), b, ["game"], "frame", "start", [], within=1800)
    return out.select("game", "touch_id", F.abs(F.col("asof_time") - F.col("frame")).alias("distance"))


@query(f"""WITH {TOUCHES} SELECT game, touch_id FROM touches a WHERE action_type = 'spike' AND EXISTS (SELECT 1 FROM touches b WHERE a.game = b.game AND a.rally = b.rally AND a.player <> b.player AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 2.5)""")
def players_in_reach(spark: SparkSession, d: str) -> DataFrame:
    """Spikes that some other player of the rally is near enough to have made."""
    t = touches(spark, d)
    others = t.select("game", "rally", F.col("player").alias("p"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = (F.col("p") != F.col("player")) & (scalars.distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) <= 2.5)
    return spatial.any_within(t.where("action_type = 'spike'"), others, ["game", "rally"], near).select("game", "touch_id")


@query("""WITH pred AS (SELECT l_suppkey % 20 AS clip, l_orderkey AS frame, avg(l_quantity) AS x, bool_or(l_returnflag <> 'N') AS found FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL), truth AS (SELECT l_suppkey % 20 AS clip, l_orderkey AS frame, avg(l_quantity) AS x, bool_or(l_linestatus = 'F') AS visible FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL), e AS (SELECT clip, found, visible, abs(p.x - t.x) AS err FROM pred p JOIN truth t USING (clip, frame))
SELECT clip, count(*) FILTER (visible AND found AND err <= 8) AS correct, count(*) FILTER (visible AND found AND err > 8) AS wrong, count(*) FILTER (visible AND NOT found) AS missed, count(*) FILTER (NOT visible AND found) AS false_positive, count(*) FILTER (NOT visible AND NOT found) AS absent FROM e GROUP BY clip""")
def truth_frames(spark: SparkSession, d: str) -> DataFrame:
    """Predictions joined to the truth by frame; frames that lack either are skipped."""
    l = table(spark, d, "lineitem").withColumn("clip", F.col("l_suppkey") % 20)
    side = lambda odd, name, flag: l.where(F.col("l_linenumber") % 2 == odd).groupBy("clip", F.col("l_orderkey").alias("frame")).agg(F.avg("l_quantity").alias(f"x{odd}"), F.bool_or(flag).alias(name))
    both = side(1, "found", F.col("l_returnflag") != "N").join(side(0, "visible", F.col("l_linestatus") == "F"), ["clip", "frame"])
    return detection.truth_metrics(both, ["clip"], F.col("visible"), F.col("found"), F.abs(F.col("x1") - F.col("x0")), 8).select("clip", "correct", "wrong", "missed", "false_positive", "absent")


@query(f"""WITH {TOUCHES}, w AS (SELECT game, min(frame) + 86400 AS lo, max(frame) - 86400 AS hi FROM touches GROUP BY game), k AS (SELECT t.* FROM touches t JOIN w ON t.game = w.game WHERE t.frame BETWEEN lo AND hi AND player % 5 <> 4), e AS (SELECT *, CASE WHEN frame = max(frame) OVER (PARTITION BY game, rally) THEN 1 ELSE 0 END AS ends FROM k)
SELECT game, player, count(*) AS total_hits, {_COUNTS}, count(DISTINCT rally) AS rallies, CAST(sum(ends) AS BIGINT) AS ending_touches, round(sum(ends) / count(*), 6) AS ending_rate FROM e GROUP BY game, player""")
def trimmed_consolidation(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of what a trim leaves: only touches inside it that belong to somebody count, also as the last of a rally."""
    t = touches(spark, d)
    w = t.groupBy("game").agg((F.min("frame") + 86_400).alias("lo"), (F.max("frame") - 86_400).alias("hi"))
    kept = t.join(w, "game").where(F.col("frame").between(F.col("lo"), F.col("hi")) & (F.col("player") % 5 != 4))
    return stats.consolidated(kept).withColumn("ending_rate", F.round("ending_rate", 6))


@query(f"""WITH {TOUCHES}, c AS (SELECT game, player, rally, count(*) FILTER (x < 9.0 AND height IS NOT NULL) AS a, count(*) FILTER (x >= 9.0 AND height IS NOT NULL) AS b FROM touches GROUP BY ALL)
SELECT game, player, rally, CASE WHEN a + b > 0 THEN CASE WHEN a >= b THEN 'A' ELSE 'B' END END AS side, round(CASE WHEN a + b > 0 THEN greatest(a, b) / (a + b) ELSE 0 END, 6) AS confidence FROM c""")
def side_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The side a player is mostly on in a rally, and how sure that is."""
    seen = F.col("height").isNotNull()
    c = touches(spark, d).groupBy("game", "player", F.col("rally").cast("long").alias("rally")).agg(F.count_if((F.col("x") < 9.0) & seen).alias("a"), F.count_if((F.col("x") >= 9.0) & seen).alias("b"))
    side, sure = scalars.side_of(F.col("a"), F.col("b"))
    return c.select("game", "player", "rally", side.alias("side"), r6(sure, "confidence"))


@query("""SELECT s_suppkey AS clip, round(coalesce(0.5 * median(sqrt(pow(l_quantity, 2) + pow(l_tax * 100, 2))), 0), 6) AS floor FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_discount >= 0.09 AND l_tax >= 0.07) ON l_suppkey = s_suppkey GROUP BY ALL""")
def size_floors(spark: SparkSession, d: str) -> DataFrame:
    """Half the median diagonal of sure boxes of each clip; 0 without any."""
    sure = table(spark, d, "lineitem").where("l_discount >= 0.09 and l_tax >= 0.07").groupBy("l_suppkey").agg((0.5 * F.median(F.sqrt(F.pow("l_quantity", 2) + F.pow(F.col("l_tax") * 100, 2)))).alias("m"))
    return table(spark, d, "supplier").join(sure, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("clip"), r6(F.coalesce("m", F.lit(0.0)), "floor"))


@query(f"""WITH {RALLIES} SELECT t.game, t.touch_id FROM touches t WHERE EXISTS (SELECT 1 FROM rallies r WHERE r.n >= 4 AND r.game = t.game AND t.frame BETWEEN r.start - 600 AND r."end" + 600)""")
def touches_in_windows(spark: SparkSession, d: str) -> DataFrame:
    """Touches inside any window around a rally of four touches or more."""
    w = rallies(spark, d).where("n >= 4").select("game", (F.col("start") - 600).alias("start"), (F.col("end") + 600).alias("end"))
    return intervals.inside_any(touches(spark, d).select("game", "touch_id", "frame"), w, ["game"], "frame", "start", "end", 21_600).select("game", "touch_id")


@query(f"""WITH {RALLIES}, w AS (SELECT * FROM rallies WHERE n >= 12) SELECT t.game, t.touch_id FROM touches t WHERE t.game NOT IN (SELECT game FROM w) OR EXISTS (SELECT 1 FROM w r WHERE r.game = t.game AND t.frame BETWEEN r.start - 600 AND r."end" + 600)""")
def touches_in_windows_if_any(spark: SparkSession, d: str) -> DataFrame:
    """Touches inside any window around a rally of twelve touches or more; games without one keep all."""
    w = rallies(spark, d).where("n >= 12").select("game", (F.col("start") - 600).alias("start"), (F.col("end") + 600).alias("end"))
    return intervals.inside_any(touches(spark, d).select("game", "touch_id", "frame"), w, ["game"], "frame", "start", "end", 21_600, all_without=True).select("game", "touch_id")


@query(f"""WITH {TOUCHES}, p AS (SELECT game, player, frame, avg(x) AS x FROM touches GROUP BY ALL), q AS (SELECT game, player, frame + 3600 AS moment FROM p), b AS (SELECT q.*, p.frame AS f0, p.x AS x0 FROM q ASOF LEFT JOIN p ON q.game = p.game AND q.player = p.player AND q.moment >= p.frame),
a AS (SELECT b.*, p.frame AS f1, p.x AS x1 FROM b ASOF LEFT JOIN p ON b.game = p.game AND b.player = p.player AND b.moment <= p.frame) SELECT game, player, moment, round(CASE WHEN f1 - moment <= 172800 THEN x0 + (x1 - x0) * CASE WHEN f1 > f0 THEN greatest(0.0, least(1.0, (moment - f0) / (f1 - f0))) ELSE 0 END ELSE x0 END, 6) AS x FROM a""")
def interpolated_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each player's place an hour after every touch: on the line to the next one if that is within two days, else where they were."""
    p = touches(spark, d).groupBy("game", "player", "frame").agg(F.avg("x").alias("x"))
    q = p.select("game", "player", (F.col("frame") + 3600).alias("moment"))
    b = asof.backward(q, p, ["game", "player"], "moment", "frame", ["x"], prefix="b_")
    a = asof.forward(b, p, ["game", "player"], "moment", "frame", ["x"], within=172_800, prefix="a_")
    share = F.when(F.col("a_time") > F.col("b_time"), scalars.clamp01((F.col("moment") - F.col("b_time")) / (F.col("a_time") - F.col("b_time")))).otherwise(0.0)
    return a.select("game", "player", "moment", r6(F.when(F.col("a_time").isNotNull(), F.col("b_x") + (F.col("a_x") - F.col("b_x")) * share).otherwise(F.col("b_x")), "x"))


@query(f"""WITH {TOUCHES} SELECT game, touch_id, array_to_string(list(touch_id) OVER (PARTITION BY game ORDER BY frame, touch_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), ',') AS trail FROM touches""")
def trails(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen latest touches at each touch."""
    w = Window.partitionBy("game").orderBy("frame", "touch_id").rowsBetween(-14, 0)
    return touches(spark, d).select("game", "touch_id", F.array_join(F.collect_list(F.col("touch_id").cast("string")).over(w), ",").alias("trail"))


@query(f"""WITH {TOUCHES}, p AS (SELECT game, rally // 16 AS part, min(frame) AS s, max(frame) - min(frame) + 1 AS duration FROM touches GROUP BY ALL), o AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY game ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p)
SELECT t.game, t.touch_id, CAST(t.frame - s + off AS BIGINT) AS frame, CAST(part * 1000 + player AS BIGINT) AS player FROM touches t JOIN o ON o.game = t.game AND o.part = t.rally // 16""")
def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a game laid end to end, with the ids of each part's players kept apart."""
    t = touches(spark, d).withColumn("part", F.floor(F.col("rally") / 16))
    p = t.groupBy("game", "part").agg(F.min("frame").alias("s"), (F.max("frame") - F.min("frame") + 1).alias("duration"))
    o = upserts.concatenated(p, "game", "part", "duration")
    return t.join(o, ["game", "part"]).select("game", "touch_id", (F.col("frame") - F.col("s") + F.col("offset")).cast("long").alias("frame"), (F.col("part") * 1000 + F.col("player")).cast("long").alias("player"))


@query("""SELECT l_orderkey AS game, l_linenumber AS line, round(sum(0.2 * abs((CAST(l_quantity / 50 >= 0.45 AS INT) + CAST(l_quantity / 50 >= 0.7 AS INT) + CAST(l_quantity / 50 >= 1.0 AS INT)) - (CAST(l_discount * 12 >= 0.45 AS INT) + CAST(l_discount * 12 >= 0.7 AS INT) + CAST(l_discount * 12 >= 1.0 AS INT))) / 3), 6) AS penalty FROM lineitem GROUP BY ALL""")
def shape_penalties(spark: SparkSession, d: str) -> DataFrame:
    """What comparing boxes of two shapes costs."""
    cost = scalars.bin_penalty(scalars.shape_bin(F.col("l_quantity") / 50), scalars.shape_bin(F.col("l_discount") * 12))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("line")).agg(r6(F.sum(cost), "penalty"))


@query("""SELECT o_orderkey AS game, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day, TIMESTAMP '1904-01-01 00:00:00' + INTERVAL 1 SECOND * o_orderkey * 1000 AS created FROM orders""")
def game_dates(spark: SparkSession, d: str) -> DataFrame:
    """Times of games as ISO text and calendar day, and dates counted in seconds since 1904."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("game"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.expr("timestamp_ntz'1904-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, o_orderkey * 1000)").alias("created"))


@query("""SELECT c_custkey AS player FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey""")
def roster_without_big_games(spark: SparkSession, d: str) -> DataFrame:
    """Members of rosters who are in no game of a large total."""
    big = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("player"))


@query("""WITH s AS (SELECT l_suppkey * 8 + l_linenumber AS game, l_partkey AS m, l_orderkey * 10 AS s, l_orderkey * 10 + CAST(l_quantity AS BIGINT) AS e FROM lineitem), p AS (SELECT DISTINCT a.game, a.m AS a, b.m AS b FROM s a JOIN s b ON a.game = b.game AND a.m < b.m) SELECT p.game, p.a, p.b, min(greatest(a.s - b.e, b.s - a.e)) AS gap FROM p JOIN s a ON p.game = a.game AND p.a = a.m JOIN s b ON p.game = b.game AND p.b = b.m GROUP BY ALL HAVING min(greatest(a.s - b.e, b.s - a.e)) BETWEEN 1 AND 1800""")
def part_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parts of a supplier's equal lines whose spans never overlap and come within 1800 frames of each other."""
    c = F.col
    s = table(spark, d, "lineitem").select((c("l_suppkey") * 8 + c("l_linenumber")).alias("game"), c("l_partkey").alias("m"), (c("l_orderkey") * 10).alias("s"), (c("l_orderkey") * 10 + c("l_quantity").cast("long")).alias("e"))
    return intervals.least_gaps(s, ["game"], "m", "s", "e", 1800)


@query("""WITH u AS (SELECT trim(source) AS name, 0 AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT upper(trim(source)), 1 FROM documents UNION ALL SELECT upper(trim(lang)), 2 FROM documents) SELECT arg_min(name, (part, name)) AS name FROM u WHERE name <> '' GROUP BY lower(name)""".replace("(part, name)", "row(part, name)"))
def rosters_united(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive union of three rosters, of which each has names of its own."""
    doc = table(spark, d, "documents")
    return upserts.union_ignoring_case([doc.where("doc_id % 2 = 0").select(F.col("source").alias("name")), doc.select(F.upper("source").alias("name")), doc.select(F.upper("lang").alias("name"))], "name")


_CLUSTERS = "clusters AS (SELECT game, id, min(id) OVER (PARTITION BY game, player % 2) AS cluster FROM box)"


def _clusters(boxes: DataFrame) -> DataFrame:
    return boxes.select("game", "id", F.min("id").over(Window.partitionBy("game", F.col("player") % 2)).alias("cluster"))


@query(f"""WITH {_BOX}, {_CLUSTERS} SELECT game, cluster, CAST(floor(x1 / 10) AS BIGINT) AS frame, id FROM box JOIN clusters USING (game, id) QUALIFY row_number() OVER (PARTITION BY game, cluster, floor(x1 / 10) ORDER BY (x2 - x1) * (y2 - y1) DESC, id) = 1""")
def cluster_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of merged tracklets: the larger one of each frame."""
    b = _boxes(spark, d).withColumn("frame", F.floor(F.col("x1") / 10))
    out = members.merged_boxes(b, _clusters(b), ["game"], "id", "frame", scalars.box_area(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    return out.select("game", "cluster", F.col("frame").cast("long").alias("frame"), "id")


@query(f"""WITH g AS (SELECT label AS game, vec_id AS id, vec_id % 3 AS cluster, vec_id % 4 AS bucket, vec_id % CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 7 END AS isolation FROM embeddings), r AS (SELECT *, count(*) OVER w AS n, min(isolation) OVER w = max(isolation) OVER w AS flat, row_number() OVER (PARTITION BY game, cluster, bucket ORDER BY id) - 1 AS pos, row_number() OVER (PARTITION BY game, cluster, bucket ORDER BY isolation DESC, id) AS k FROM g WINDOW w AS (PARTITION BY game, cluster, bucket))
SELECT game, cluster, bucket, id FROM r WHERE n <= 10 OR CASE WHEN flat THEN list_contains([CAST(round_even(k2 * (n - 1) / 9.0, 0) AS BIGINT) for k2 in range(10)], pos) ELSE k <= 10 END""")
def cluster_galleries(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that merged tracklets keep of each shape."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("game"), F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("bucket"), F.when(F.col("vec_id") % 4 == 0, 0).otherwise(F.col("vec_id") % 7).alias("isolation"))
    clusters = e.select("game", "id", (F.col("id") % 3).alias("cluster"))
    return members.merged_gallery(e, clusters, ["game"], "id", "bucket", "isolation", ["id"]).select("game", "cluster", "bucket", "id")


@query(f"""WITH {_BOX}, {_CLUSTERS} SELECT game, cluster, CAST(floor(y1) AS BIGINT) AS zone, count(*) AS n FROM box JOIN clusters USING (game, id) GROUP BY ALL""")
def cluster_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zone counts of merged tracklets added up."""
    b = _boxes(spark, d)
    own = b.groupBy("game", "id", F.floor("y1").cast("long").alias("zone")).agg(F.count("*").alias("n"))
    return members.summed_histograms(own, _clusters(b), ["game"], "id", "zone", "n")
