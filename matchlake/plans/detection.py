"""Detections, hits, identities and profiles on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import scalars
from matchlake.operators import detection, intervals, stats, vectors
from matchlake.plans.bindings import TOUCHES, table, touches
from matchlake.plans.scoring import SCORED, wide
from matchlake.plans.tracking import _WON, _won
from matchlake.operators import quality

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


_CAND = """cand AS (SELECT l_suppkey % 50 AS game, l_orderkey AS frame, l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, l_quantity AS x, l_discount * 100 AS y, 10 + l_tax * 100 AS w, 12 + l_discount * 50 AS h, l_discount * 10 AS conf FROM lineitem)"""


def _cand(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select((c("l_suppkey") % 50).alias("game"), c("l_orderkey").alias("frame"), c("l_linenumber").alias("id"), F.when(c("l_linenumber") % 2 == 0, "m1").otherwise("m2").alias("model"), c("l_quantity").alias("x"), (c("l_discount") * 100).alias("y"), (10 + c("l_tax") * 100).alias("w"), (12 + c("l_discount") * 50).alias("h"), (c("l_discount") * 10).alias("conf"))


@query(f"""WITH {_CAND}, b AS (SELECT a.frame, a.id, max(o.conf) AS best FROM cand a JOIN cand o ON a.frame = o.frame AND a.model <> o.model AND sqrt(pow(o.x - a.x, 2) + pow(o.y - a.y, 2)) <= 12 GROUP BY ALL)
SELECT frame, id, round(coalesce(1 - (1 - conf) * (1 - best), conf), 6) AS combined FROM cand LEFT JOIN b USING (frame, id)""")
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = detection.agreed(_cand(spark, d), ["frame"], "id", "model", "x", "y", "conf", 12.0)
    return out.select("frame", "id", r6(F.col("combined"), "combined"))


@query(f"""WITH {_CAND}, f AS (SELECT *, row_number() OVER (PARTITION BY game, frame ORDER BY conf DESC, id) AS k FROM cand), p AS (SELECT game, count(*) AS n, avg(w) AS mw, stddev_pop(w) AS sw, avg(h) AS mh, stddev_pop(h) AS sh FROM f WHERE k = 1 AND conf >= 0.6 GROUP BY game HAVING count(*) >= 30),
o AS (SELECT cand.*, CASE WHEN n IS NOT NULL THEN greatest(0.0, greatest(0.0, mw - 1.5 * sw) - w, w - (mw + 1.5 * sw)) + greatest(0.0, greatest(0.0, mh - 1.5 * sh) - h, h - (mh + 1.5 * sh)) ELSE 0 END AS off FROM cand LEFT JOIN p USING (game)),
b AS (SELECT *, row_number() OVER (PARTITION BY game, frame ORDER BY round(off, 9), conf DESC, id) AS k FROM o) SELECT game, frame, CASE WHEN conf >= 0.6 THEN id END AS id FROM b WHERE k = 1""")
def ball_selection(spark: SparkSession, d: str) -> DataFrame:
    """The ball of every frame in two passes."""
    return detection.selected(_cand(spark, d), "game", "frame", "id", "w", "h", "conf")


_POINTS = """points AS (SELECT game, frame // 600 AS t, avg(x) AS x, avg(y) AS y FROM touches GROUP BY game, frame // 600)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).groupBy("game", F.floor(F.col("frame") / 600).alias("t")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query(f"""WITH {TOUCHES}, {_POINTS}, n AS (SELECT game, t, x, y, last_value(t) OVER b AS bt, last_value(x) OVER b AS bx, last_value(y) OVER b AS b_y, first_value(t) OVER a AS a_t, first_value(x) OVER a AS ax, first_value(y) OVER a AS ay FROM points
 WINDOW b AS (PARTITION BY game ORDER BY t RANGE BETWEEN 15 PRECEDING AND 5 PRECEDING), a AS (PARTITION BY game ORDER BY t RANGE BETWEEN 5 FOLLOWING AND 15 FOLLOWING)),
v AS (SELECT game, t, x - bx AS ux, y - b_y AS uy, ax - x AS vx, ay - y AS vy, t - bt AS din, a_t - t AS dout FROM n WHERE bt IS NOT NULL AND a_t IS NOT NULL),
s AS (SELECT game, t, CASE WHEN sqrt(ux*ux+uy*uy) >= 1e-6 AND sqrt(vx*vx+vy*vy) >= 1e-6 THEN degrees(acos(greatest(-1.0, least(1.0, (ux*vx+uy*vy) / (sqrt(ux*ux+uy*uy) * sqrt(vx*vx+vy*vy)))))) END AS turn, sqrt(ux*ux+uy*uy) / din AS speed_in, sqrt(vx*vx+vy*vy) / dout AS speed_out FROM v)
SELECT game, t, round(turn, 5) AS turn, round(speed_in, 6) AS speed_in, round(speed_out, 6) AS speed_out FROM s WHERE turn >= 40 OR speed_in <= 1e-6 OR greatest(speed_in, speed_out) / speed_in >= 1.6""")
def hit_detection(spark: SparkSession, d: str) -> DataFrame:
    out = detection.hits(_points(spark, d), ["game"], "t", "x", "y")
    return out.select("game", "t", F.round("turn", 5).alias("turn"), r6(F.col("speed_in"), "speed_in"), r6(F.col("speed_out"), "speed_out"))


@query(f"""WITH {TOUCHES}, c AS (SELECT game, touch_id, x, frame - min(frame) OVER (PARTITION BY game, rally) AS since, speed AS so, lag(speed) OVER w AS po, coalesce(lag(speed) OVER w, 0.0) AS si, y * 20 AS turn FROM touches WINDOW w AS (PARTITION BY game, rally ORDER BY frame, touch_id))
SELECT game, touch_id, CASE WHEN since <= 60 THEN 'serve' WHEN abs(x - 9.0) <= 2.5 AND turn >= 120 THEN 'block' WHEN abs(x - 9.0) <= 2.5 AND so > si THEN 'spike' WHEN po >= 8 AND so < po THEN 'dig' WHEN so < si THEN 'set' ELSE 'hit' END AS class FROM c""")
def rule_classes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("game", "rally").orderBy("frame", "touch_id")
    t = touches(spark, d).withColumns({"since": F.col("frame") - F.min("frame").over(Window.partitionBy("game", "rally")), "po": F.lag("speed").over(w)})
    made = detection.action_class(F.col("since"), 60, F.col("x"), F.col("y") * 20, F.coalesce("po", F.lit(0.0)), F.col("speed"), F.col("po"))
    return t.select("game", "touch_id", made.alias("class"))


_SPANS = "spans AS (SELECT game, player AS m, rally // 6 AS part, min(frame) AS s, max(frame) AS e FROM touches GROUP BY ALL)"


@query(f"""WITH {TOUCHES}, {_SPANS}, p AS (SELECT DISTINCT a.game, a.m AS a, b.m AS b FROM spans a JOIN spans b ON a.game = b.game AND a.m < b.m) SELECT a.game, p.a, p.b, min(greatest(a.s - b.e, b.s - a.e)) AS gap FROM p JOIN spans a ON p.game = a.game AND p.a = a.m JOIN spans b ON p.game = b.game AND p.b = b.m GROUP BY a.game, p.a, p.b HAVING min(greatest(a.s - b.e, b.s - a.e)) > 0""")
def span_bridges(spark: SparkSession, d: str) -> DataFrame:
    s = touches(spark, d).groupBy("game", F.col("player").alias("m"), F.floor(F.col("rally") / 6).alias("part")).agg(F.min("frame").alias("s"), F.max("frame").alias("e"))
    ids = s.select("game", "m").distinct()
    pairs = ids.select("game", F.col("m").alias("a")).join(ids.select("game", F.col("m").alias("b")), "game").where("a < b")
    return detection.bridged(s, pairs, ["game"], "m", "s", "e")


@query("""WITH p AS (SELECT l_orderkey AS game, l_linenumber AS line, l_quantity * 60 AS gap, l_discount * 30 AS metres, l_tax * 10 AS zone, l_discount * 3 AS app, CASE WHEN l_returnflag = 'R' THEN l_tax * 10 END AS opp FROM lineitem)
SELECT game, line, round(CASE WHEN coalesce(opp, 0) >= 0.7 THEN NULL ELSE CASE WHEN c <= 0.45 THEN c END END, 6) AS cost FROM (SELECT *, CASE WHEN gap > 1800 THEN NULL WHEN gap <= 15 AND metres <= 1.0 THEN 0.05 * metres WHEN zone > 0.85 OR app > 0.22 THEN NULL ELSE 0.45 * app + 0.40 * zone + 0.15 * least(1.0, gap / 1800.0) + CASE WHEN opp IS NOT NULL THEN 0.35 * opp ELSE 0 END END AS c FROM p)""")
def pair_costs(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    opposite = F.when(c("l_returnflag") == "R", c("l_tax") * 10)
    cost = detection.pair_cost(c("l_quantity") * 60, c("l_discount") * 30, c("l_tax") * 10, c("l_discount") * 3, opposite)
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("game"), c("l_linenumber").alias("line"), r6(cost, "cost"))


_SAMPLES = "samples AS (SELECT game, rally // 4 AS set_index, CASE WHEN x < 9.0 THEN 'A' ELSE 'B' END AS side, CASE WHEN player % 5 < 2 THEN 'x' WHEN player % 5 < 4 THEN 'y' END AS team, count(*) AS n FROM touches GROUP BY ALL)"


@query(f"""WITH {TOUCHES}, {_SAMPLES}, v AS (SELECT game, set_index, coalesce(sum(n) FILTER (side = 'A' AND team = 'x'), 0) AS ax, coalesce(sum(n) FILTER (side = 'A' AND team = 'y'), 0) AS ay, coalesce(sum(n) FILTER (side = 'B' AND team = 'x'), 0) AS bx, coalesce(sum(n) FILTER (side = 'B' AND team = 'y'), 0) AS b_y FROM samples GROUP BY ALL),
s AS (SELECT game, set_index, CASE WHEN greatest(ax, ay) >= 3 THEN CASE WHEN ax > ay THEN 'x' ELSE 'y' END END AS a, CASE WHEN greatest(bx, b_y) >= 3 THEN CASE WHEN bx > b_y THEN 'x' ELSE 'y' END END AS b FROM v)
SELECT game, set_index, CASE WHEN a = b THEN NULL ELSE coalesce(a, CASE b WHEN 'x' THEN 'y' WHEN 'y' THEN 'x' END) END AS side_a, CASE WHEN a = b THEN NULL ELSE coalesce(b, CASE a WHEN 'x' THEN 'y' WHEN 'y' THEN 'x' END) END AS side_b FROM s""")
def set_side_votes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("player") % 5
    s = touches(spark, d).select("game", F.floor(F.col("rally") / 4).alias("set_index"), F.when(F.col("x") < 9.0, "A").otherwise("B").alias("side"), F.when(p < 2, "x").when(p < 4, "y").alias("team"))
    s = s.groupBy("game", "set_index", "side", "team").agg(F.count("*").alias("n"))
    return detection.set_sides(s, ["game", "set_index"], "side", "team", "n", 3).select("game", "set_index", F.col("A").alias("side_a"), F.col("B").alias("side_b"))


@query("""WITH e AS (SELECT l_suppkey % 20 AS clip, l_returnflag <> 'N' AS v, l_linestatus = 'F' OR l_quantity > 25 AS f, abs(l_quantity - 25) AS err FROM lineitem), g AS (SELECT clip, count(*) FILTER (v AND f AND err <= 8) AS correct, count(*) FILTER (v AND f AND err > 8) AS wrong, count(*) FILTER (v AND NOT f) AS missed, count(*) FILTER (NOT v AND f) AS false_positive, count(*) FILTER (NOT v AND NOT f) AS absent, round(avg(err) FILTER (v AND f), 6) AS mean_error, list_sort(list(err) FILTER (v AND f)) AS l FROM e GROUP BY clip)
SELECT clip, correct, wrong, missed, false_positive, absent, mean_error, round(correct / nullif(correct + wrong + missed, 0), 6) AS recall, l[len(l) // 2 + 1] AS median_error, l[CAST(floor(len(l) * 0.9) AS INT) + 1] AS p90_error FROM g""")
def truth_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Detections against ground truth by clip."""
    l = table(spark, d, "lineitem").withColumn("clip", F.col("l_suppkey") % 20)
    out = detection.truth_metrics(l, ["clip"], F.col("l_returnflag") != "N", (F.col("l_linestatus") == "F") | (F.col("l_quantity") > 25), F.abs(F.col("l_quantity") - 25), 8)
    return out.withColumns({"recall": F.round("recall", 6), "mean_error": F.round("mean_error", 6)})


@query(f"""WITH {TOUCHES}, m AS (SELECT * FROM touches WHERE player % 7 <> 3), g AS (SELECT game, touch_id, CASE WHEN player % 2 = 1 THEN player - 1 ELSE player END AS player FROM m) SELECT * FROM g WHERE player % 7 <> 3""")
def canonical_touches(spark: SparkSession, d: str) -> DataFrame:
    """Odd players count as their even neighbours; every seventh is ignored, before or after."""
    t = touches(spark, d)
    ids = t.select("game", F.col("player").alias("id")).distinct()
    mapping = ids.where("id % 2 = 1").withColumn("canonical", F.col("id") - 1)
    every = ids.select("game", "id").union(mapping.select("game", "canonical")).distinct()
    return detection.grouped_touches(t, mapping, every.where("id % 7 = 3"), "game", "player").select("game", "touch_id", "player")


@query(f"""WITH {TOUCHES}, w AS (SELECT game, min(frame) + 86400 AS lo, max(frame) - 86400 AS hi FROM touches GROUP BY game) SELECT t.game, touch_id, frame - lo AS frame, row_number() OVER (PARTITION BY t.game ORDER BY t.frame, touch_id) - 1 AS position FROM touches t JOIN w ON t.game = w.game WHERE t.frame BETWEEN lo AND hi""")
def trimmed_touches(spark: SparkSession, d: str) -> DataFrame:
    """Touches without a day of warm-up and one of cool-down, counted from the warm-up's end and numbered anew."""
    t = touches(spark, d)
    w = t.groupBy("game").agg((F.min("frame") + 86_400).alias("lo"), (F.max("frame") - 86_400).alias("hi"))
    rows = t.join(w, "game").where(F.col("frame").between(F.col("lo"), F.col("hi")))
    return rows.select("game", "touch_id", (F.col("frame") - F.col("lo")).alias("frame"), (F.row_number().over(Window.partitionBy("game").orderBy("frame", "touch_id")) - 1).cast("long").alias("position"))


@query(f"""WITH {_WON}, w AS (SELECT game, min(start) + 86400 AS lo, max("end") - 86400 AS hi FROM rallies GROUP BY game) SELECT r.game, r.rally, r.start - lo AS start, r."end" - lo AS "end" FROM rallies r JOIN w ON r.game = w.game WHERE r.start >= lo AND r."end" <= hi""")
def trimmed_rallies(spark: SparkSession, d: str) -> DataFrame:
    """Only rallies wholly inside the trimmed range."""
    r = _won(spark, d)
    w = r.groupBy("game").agg((F.min("start") + 86_400).alias("lo"), (F.max("end") - 86_400).alias("hi"))
    out = intervals.rebased(r.join(w, "game"), "start", "end", F.col("lo"), F.col("hi"))
    return out.select("game", F.col("rally").cast("long").alias("rally"), "start", "end")


@query(f"""WITH {_WON}, s AS (SELECT game, player, count(*) AS hits, CASE WHEN avg(x) < 9.0 THEN 'A' ELSE 'B' END AS side FROM touches GROUP BY ALL), m AS (SELECT game, count(*) FILTER (winner = 'A') AS a, count(*) FILTER (winner = 'B') AS b FROM won GROUP BY game)
SELECT player, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS games, count(*) FILTER ((side = 'A' AND a > b) OR (side = 'B' AND b > a)) AS wins, count(*) FILTER ((side = 'A' AND b > a) OR (side = 'B' AND a > b)) AS losses FROM s JOIN m USING (game) GROUP BY player""")
def player_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Hits, games, wins and losses of each player over all games."""
    s = touches(spark, d).groupBy("game", "player").agg(F.count("*").alias("hits"), F.when(F.avg("x") < 9.0, "A").otherwise("B").alias("side"))
    m = _won(spark, d).groupBy("game").agg(stats.winner(F.count_if(F.col("winner") == "A"), F.count_if(F.col("winner") == "B"), "A", "B").alias("w"))
    return s.join(m, "game").groupBy("player").agg(F.sum("hits").alias("hits"), F.count("*").alias("games"), F.count_if(F.col("w") == F.col("side")).alias("wins"), F.count_if(F.col("w") != F.col("side")).alias("losses"))


@query(f"""WITH {SCORED}, g AS (SELECT game, player, round(avg(score), 9) AS a, count(score) AS n FROM scored GROUP BY ALL HAVING count(score) > 0) SELECT game, player, round(a, 6) AS average FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY a DESC, player) AS k FROM g) WHERE k = 1""")
def most_valuable(spark: SparkSession, d: str) -> DataFrame:
    """Each game's player of the best mean score; of equals the smallest id."""
    g = quality.scored(wide(spark, d)).groupBy("game", "player").agg(F.round(F.avg("score"), 9).alias("a")).where("a is not null")
    return stats.top_n(g, ["game"], [F.desc("a"), "player"], 1).select("game", "player", r6(F.col("a"), "average"))


@query(f"""WITH {TOUCHES}, f AS (SELECT game, player, avg(CASE WHEN x BETWEEN 1.0 AND 17.0 AND y BETWEEN 0 AND 8 THEN 1.0 ELSE 0.0 END) AS share FROM touches GROUP BY ALL) SELECT game, player, round(share, 6) AS share, share < 0.7 AS auto_ignored FROM f""")
def auto_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Players who are too seldom inside the court."""
    inside = F.col("x").between(1.0, 17.0) & F.col("y").between(0, 8)
    out = touches(spark, d).groupBy("game", "player").agg(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("s"))
    return out.select("game", "player", r6(F.col("s"), "share"), (F.col("s") < 0.7).alias("auto_ignored"))


@query(f"""WITH {TOUCHES} SELECT game, array_to_string(list_sort(list(DISTINCT action_type)), ',') AS types, count(DISTINCT rally) AS rallies, count(DISTINCT player) AS players FROM touches GROUP BY game""")
def game_facets(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).groupBy("game").agg(F.array_join(F.sort_array(F.collect_set("action_type")), ",").alias("types"), F.countDistinct("rally").alias("rallies"), F.countDistinct("player").alias("players"))


@query(f"""WITH {TOUCHES} SELECT game, touch_id, CASE WHEN touch_id % 3 <> 0 THEN printf('%d km/h', CAST(round_even(speed * 3.6, 0) AS BIGINT)) ELSE printf('%d px/s', CAST(round_even(speed, 0) AS BIGINT)) END AS label FROM touches WHERE action_type IN ('serve', 'spike') AND rally < 20""")
def speed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Facet filters and labelled speeds."""
    t = touches(spark, d).where(F.col("action_type").isin("serve", "spike") & (F.col("rally") < 20))
    return t.select("game", "touch_id", scalars.speed_label(F.col("speed"), F.col("touch_id") % 3 != 0).alias("label"))


@query(f"""WITH {TOUCHES} SELECT game, touch_id, CASE WHEN touch_id % 3 <> 0 THEN printf('%d km/h', CAST(round_even(speed * 3.6, 0) AS BIGINT)) ELSE printf('%d px/s', CAST(round_even(speed, 0) AS BIGINT)) END AS label FROM touches WHERE action_type IN ('serve', 'spike')""")
def speed_labels_all(spark: SparkSession, d: str) -> DataFrame:
    """Labelled speeds of all rallies."""
    t = touches(spark, d).where(F.col("action_type").isin("serve", "spike"))
    return t.select("game", "touch_id", scalars.speed_label(F.col("speed"), F.col("touch_id") % 3 != 0).alias("label"))


_PARTS = "parts AS (SELECT *, player * 1000 + rally // 2 AS m FROM touches)"
_GALLERY = "gallery AS (SELECT game, m, embedding::DOUBLE[] AS v, label % 4 AS bin FROM parts JOIN embeddings ON vec_id = touch_id)"
_MEANS = "SELECT a.game, a.m AS a, b.m AS b, avg(least(1.0, greatest(0.0, least(1.0, (1 - list_dot_product(a.v, b.v)) / 2)) + 0.2 * abs(a.bin - b.bin) / 3)) AS distance FROM gallery a JOIN gallery b ON a.game = b.game AND a.m < b.m GROUP BY ALL"


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A player's touches of two rallies as a tracklet m, and the vectors of those touches that have one."""
    p = touches(spark, d).withColumn("m", F.col("player") * 1000 + F.floor(F.col("rally") / 2))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("touch_id"), "embedding", (F.col("label") % 4).alias("bin"))
    return p, p.select("game", "m", "touch_id").join(e, "touch_id")


@query(f"""WITH {TOUCHES}, {_PARTS}, {_GALLERY} SELECT game, a, b, round(distance, 5) AS distance FROM ({_MEANS})""")
def gallery_distances(spark: SparkSession, d: str) -> DataFrame:
    """Mean distances of the galleries of a game's tracklets, with the cost of differing shapes."""
    _, gallery = _parts(spark, d)
    return vectors.gallery_distance(gallery, gallery, "m", "m", "embedding", ["game"], "bin").withColumn("distance", F.round("distance", 5))


@query(f"""WITH {TOUCHES}, {_PARTS}, {_GALLERY}, spans AS (SELECT game, m, min(frame) AS s, max(frame) AS e, count(*) AS n, count(*) FILTER (x < 9.0) AS l FROM parts GROUP BY ALL),
zones AS (SELECT game, m, CAST(floor(x / 3) AS INT) AS z, count(*) AS n FROM parts GROUP BY ALL),
shared AS (SELECT a.game, a.m AS a, b.m AS b, sum(least(a.n / s.n, b.n / t.n)) AS o FROM zones a JOIN zones b ON a.game = b.game AND a.z = b.z AND a.m < b.m JOIN spans s ON s.game = a.game AND s.m = a.m JOIN spans t ON t.game = b.game AND t.m = b.m GROUP BY ALL)
SELECT game, a, b, round(distance, 5) AS distance FROM ({_MEANS}) d JOIN spans s USING (game) JOIN spans t USING (game) LEFT JOIN shared USING (game, a, b)
WHERE s.m = a AND t.m = b AND greatest(s.s - t.e, t.s - s.e) > 0 AND 1 - coalesce(o, 0) <= 0.95 AND NOT ((s.l >= s.n - s.l) <> (t.l >= t.n - t.l) AND greatest(s.l, s.n - s.l) / s.n >= 0.7 AND greatest(t.l, t.n - t.l) / t.n >= 0.7) AND distance <= 0.34""")
def candidate_matches(spark: SparkSession, d: str) -> DataFrame:
    """Tracklets of a game that may be one player."""
    p, gallery = _parts(spark, d)
    p = p.withColumns({"zone": F.floor(F.col("x") / 3).cast("int"), "side": F.when(F.col("x") < 9.0, "A").otherwise("B")})
    spans = p.groupBy("game", "m").agg(F.min("frame").alias("s"), F.max("frame").alias("e"))
    return detection.candidate_matches(spans, p, gallery, ["game"], "m", "s", "e", "zone", "side", "embedding", "bin").withColumn("distance", F.round("distance", 5))
