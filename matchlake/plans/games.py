"""Frame look-ups, regions of interest, shortlists and outcome filters on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import scalars
from matchlake.operators import asof, graph, intervals, stats, upserts
from matchlake.plans.bindings import RALLIES, TOUCHES, rallies, table, touches
from matchlake.plans.tracking import _WON, _won

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


@query(f"""WITH {TOUCHES}, roi AS (SELECT game, min(x) - 0.08 * 20 AS x1, max(x) + 0.08 * 20 AS x2, max(y) + 0.08 * 20 AS y2 FROM touches WHERE action_type = 'serve' GROUP BY game)
SELECT t.game, count(*) AS n FROM touches t JOIN roi USING (game) WHERE t.x BETWEEN x1 AND x2 AND t.y BETWEEN 0 AND y2 AND sqrt(pow(speed, 2) + pow(y, 2)) >= 1 GROUP BY t.game""")
def region_of_interest(spark: SparkSession, d: str) -> DataFrame:
    """Touches inside the box of the serves, widened by 8 %, from the top edge down, and not too small."""
    t = touches(spark, d)
    m = 0.08 * 20
    roi = t.where("action_type = 'serve'").groupBy("game").agg((F.min("x") - m).alias("x1"), (F.max("x") + m).alias("x2"), (F.max("y") + m).alias("y2"))
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(0, F.col("y2")) & (scalars.box_diagonal(F.lit(0.0), F.lit(0.0), F.col("speed"), F.col("y")) >= 1)
    return t.join(roi, "game").where(inside).groupBy("game").agg(F.count("*").alias("n"))


@query(f"""WITH {RALLIES} SELECT t.game, t.touch_id, r.rally, a.touch_id AS last_spike FROM (SELECT * FROM touches WHERE action_type = 'dig') t LEFT JOIN (SELECT * FROM rallies WHERE n >= 2) r ON t.game = r.game AND t.rally = r.rally
ASOF LEFT JOIN (SELECT game, frame, touch_id FROM touches WHERE action_type = 'spike') a ON t.game = a.game AND t.frame >= a.frame""")
def frame_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each dig its rally, if that has several touches, and the latest spike before it."""
    t = touches(spark, d)
    digs = t.where("action_type = 'dig'").select("game", "touch_id", "frame", "rally")
    r = rallies(spark, d).where("n >= 2").select("game", "rally", F.col("rally").cast("long").alias("r"))
    spikes = t.where("action_type = 'spike'").select("game", "frame", F.col("touch_id").alias("spike"))
    found = asof.backward(digs.join(r, ["game", "rally"], "left"), spikes, ["game"], "frame", "frame", ["spike"], prefix="last_")
    return found.select("game", "touch_id", F.col("r").alias("rally"), "last_spike")


@query("""WITH roster AS (SELECT n_regionkey AS slot, n_name AS team, c_mktsegment AS name FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) SELECT name, arg_min(team, (slot, team)) AS team FROM roster GROUP BY name""".replace("(slot, team)", "row(slot, team)"))
def player_team(spark: SparkSession, d: str) -> DataFrame:
    """The first team, by slot and name, whose roster holds a name."""
    r = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("slot"), F.col("n_name").alias("team"), F.col("c_mktsegment").alias("name")).distinct()
    return r.groupBy("name").agg(F.min_by("team", F.struct("slot", "team")).alias("team"))


@query(f"""WITH {_WON}, m AS (SELECT game, count(*) FILTER (winner = 'A') AS a, count(*) FILTER (winner = 'B') AS b FROM won GROUP BY game) SELECT game, a, b FROM m WHERE a > b AND game % 2 = 0""")
def games_won(spark: SparkSession, d: str) -> DataFrame:
    """Games of even teams that their side A won."""
    m = _won(spark, d).groupBy("game").agg(F.count_if(F.col("winner") == "A").alias("a"), F.count_if(F.col("winner") == "B").alias("b"))
    return m.where((F.col("a") > F.col("b")) & (F.col("game") % 2 == 0))


@query("""WITH c AS (SELECT l_orderkey AS game, l_linenumber AS id, l_returnflag AS tier, l_quantity AS area FROM lineitem), t AS (SELECT *, first_value(tier) OVER w AS best, row_number() OVER (PARTITION BY game, tier ORDER BY area DESC, id) AS k, max(area) OVER (PARTITION BY game, tier) AS largest FROM c WINDOW w AS (PARTITION BY game ORDER BY tier, area DESC, id))
SELECT game, id, area FROM t WHERE tier = best AND k <= 6 AND area >= 0.5 * largest""")
def shortlist(spark: SparkSession, d: str) -> DataFrame:
    """The first six crops of the best tier with at least half of its largest area."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("tier"), F.col("l_quantity").alias("area"))
    tier = Window.partitionBy("game", "tier")
    rows = c.withColumns({"best": F.min("tier").over(Window.partitionBy("game")), "k": F.row_number().over(tier.orderBy(F.desc("area"), "id")), "largest": F.max("area").over(tier)})
    return rows.where((F.col("tier") == F.col("best")) & (F.col("k") <= 6) & (F.col("area") >= 0.5 * F.col("largest"))).select("game", "id", "area")


@query("""SELECT l_orderkey AS game, l_linenumber AS line, round(CASE WHEN z BETWEEN -0.5 AND 12 THEN z END, 6) AS height FROM (SELECT l_orderkey, l_linenumber, 9.0 - 1400.0 * 0.21 / least(l_quantity + 5, l_discount * 200 + 12) * 0.2 AS z FROM lineitem)""")
def ball_heights(spark: SparkSession, d: str) -> DataFrame:
    """Heights from apparent size: depth is focal length by real by seen size; implausible ones are null."""
    w, h = F.col("l_quantity") + 5, F.col("l_discount") * 200 + 12
    z = 9.0 - 1400.0 * 0.21 / F.least(w, h) * 0.2
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("line"), r6(F.when(z.between(-0.5, 12), z), "height"))


@query(f"""WITH {TOUCHES}, f AS (SELECT game, action_type, sum(speed) AS s, count(*) AS n, regr_slope(speed, x) AS k, regr_intercept(speed, x) AS b FROM touches GROUP BY ALL), e AS (SELECT t.game, t.action_type, sum(pow(speed - (b + k * x), 2)) AS err, count(*) AS n FROM touches t JOIN f ON t.game = f.game AND t.action_type = f.action_type WHERE f.n >= 3 GROUP BY ALL)
SELECT game, round(sum(err) / sum(n), 4) AS mse FROM e GROUP BY game""")
def pooled_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error of line fits by type, pooled by game; fits need three points."""
    t = touches(spark, d)
    b, k = stats.fit_line(F.col("x"), F.col("speed"))
    f = t.groupBy("game", "action_type").agg(b.alias("b"), k.alias("k"), F.count("*").alias("n")).where("n >= 3")
    e = t.join(f, ["game", "action_type"]).groupBy("game").agg(F.sum(F.pow(F.col("speed") - (F.col("b") + F.col("k") * F.col("x")), 2)).alias("err"), F.count("*").alias("n"))
    return e.select("game", F.round(F.col("err") / F.col("n"), 4).alias("mse"))


@query(f"""WITH {RALLIES} SELECT count(*) AS rallies, round(avg("end" - start), 6) AS mean_duration, (SELECT count(*) FROM touches) AS touches, (SELECT count(DISTINCT player) FROM touches) AS players FROM rallies""")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    """The figures of a dashboard's head."""
    r = rallies(spark, d).agg(F.count("*").alias("rallies"), r6(F.avg(F.col("end") - F.col("start")), "mean_duration"))
    t = touches(spark, d).agg(F.count("*").alias("touches"), F.countDistinct("player").alias("players"))
    return r.join(F.broadcast(t))


@query("""WITH p AS (SELECT 'a' AS source, 'a/' || CAST(doc_id AS VARCHAR) AS id, CASE quality WHEN 0 THEN 5 WHEN 1 THEN 6 END AS label FROM labels UNION ALL SELECT 'b', 'b/' || CAST(doc_id AS VARCHAR), CASE toxic WHEN 1 THEN 7 END FROM labels),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(id || '9'), id) AS k, count(*) OVER (PARTITION BY source) AS n FROM p WHERE label IS NOT NULL)
SELECT id, CAST(label AS INT) AS label, source, CASE WHEN k <= greatest(1, floor(n * (1 - 0.2))) THEN 'train' ELSE 'val' END AS split FROM o""")
def dataset_split(spark: SparkSession, d: str) -> DataFrame:
    """Two sources with remapped classes, put into a seeded order and split."""
    l = table(spark, d, "labels")
    parts = {"a": l.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "b": l.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))}
    return upserts.dataset(parts, "id", "label", {"a": {0: 5, 1: 6}, "b": {1: 7}}, 0.2, 9)


@query(f"""WITH {TOUCHES}, p AS (SELECT game, player, rally // 8 AS part, min(frame) AS s, max(frame) + 1 AS e, count(*) AS strength FROM touches GROUP BY game, player, rally // 8),
m AS (SELECT game, player * 1000 + part AS member, s, e, strength FROM p), b AS (SELECT game, s AS t FROM m UNION SELECT game, e FROM m),
a AS (SELECT game, t, lead(t) OVER (PARTITION BY game ORDER BY t) AS u FROM b), j AS (SELECT a.game, t, u, member, row_number() OVER (PARTITION BY a.game, t ORDER BY strength, member) AS r, count(*) OVER (PARTITION BY a.game, t) AS n FROM a JOIN m ON a.game = m.game AND m.s <= a.t AND m.e >= a.u WHERE u IS NOT NULL),
x AS (SELECT game, member, sum(u - t) AS excess FROM j WHERE r <= n - 3 GROUP BY game, member) SELECT x.game, x.member FROM x JOIN m USING (game, member) WHERE excess >= 0.25 * (e - s)""")
def roster_cap(spark: SparkSession, d: str) -> DataFrame:
    """Spans beyond a cap of three for a quarter of their length."""
    t = touches(spark, d).groupBy("game", "player", F.floor(F.col("rally") / 8).alias("part")).agg(F.min("frame").alias("s"), (F.max("frame") + 1).alias("e"), F.count("*").alias("strength"))
    m = t.select("game", (F.col("player") * 1000 + F.col("part")).alias("member"), "s", "e", "strength")
    return intervals.over_cap(m, ["game"], "member", "s", "e", "strength", 3)


@query()
def tracklet_chains(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label as one track by id, cut where they jump."""
    e = table(spark, d, "embeddings").select((F.col("label") % 2).alias("game"), F.col("label").alias("track"), F.col("vec_id").alias("frame"), "embedding")
    return graph.chained(e, "game", "track", "frame", "embedding", gap=25)
