"""Identities of players on the driver's tables: duplicates, bridges, matches, consolidation and the roster cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.operators import detection, identity
from matchlake.plans.bindings import TOUCHES, table, touches

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BOXES = "b AS (SELECT l_suppkey AS game, l_linenumber AS m, l_orderkey AS f, l_discount * 100 AS x1, l_tax * 100 AS y1, l_discount * 100 + 20 AS x2, l_tax * 100 + 20 AS y2 FROM lineitem)"
_TWICE = f"""{_BOXES}, j AS (SELECT p.game, p.m AS a, q.m AS b, count(*) AS shared, avg(i / (800 - i)) AS overlap FROM (SELECT * FROM b) p JOIN b q ON p.game = q.game AND p.f = q.f AND p.m < q.m, LATERAL (SELECT (20 - abs(p.x1 - q.x1)) * (20 - abs(p.y1 - q.y1)) AS i) GROUP BY ALL),
n AS (SELECT game, m, count(*) AS n FROM b GROUP BY ALL), twice AS (SELECT j.* FROM j JOIN n x ON x.game = j.game AND x.m = a JOIN n y ON y.game = j.game AND y.m = j.b WHERE shared <= 30 AND shared <= 0.02 * least(x.n, y.n) AND overlap >= 0.4)"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's lines as boxes: line numbers are tracks, orders are frames."""
    c = F.col
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("game"), c("l_linenumber").alias("m"), c("l_orderkey").alias("f"), (c("l_discount") * 100).alias("x1"), (c("l_tax") * 100).alias("y1"), (c("l_discount") * 100 + 20).alias("x2"), (c("l_tax") * 100 + 20).alias("y2"))


def _twice(boxes: DataFrame) -> DataFrame:
    return detection.seen_twice(boxes, ["game"], "m", "f", ("x1", "y1", "x2", "y2"), 16.0)


@query(f"WITH {_TWICE} SELECT game, a, b, shared, round(overlap, 6) AS overlap FROM twice")
def duplicate_detections(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of which some boxes are one body seen twice."""
    return _twice(_boxes(spark, d)).withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH {_TWICE}, s AS (SELECT game, m, f // 5000 AS part, min(f) AS s, max(f) AS e FROM b GROUP BY ALL), g AS (SELECT x.game, x.m AS a, y.m AS b, min(greatest(x.s - y.e, y.s - x.e)) AS gap FROM s x JOIN s y ON x.game = y.game AND x.m < y.m GROUP BY ALL)
SELECT g.game, g.a, g.b, greatest(gap, 0) AS gap, t.a IS NOT NULL AS twice FROM g LEFT JOIN twice t ON t.game = g.game AND t.a = g.a AND t.b = g.b WHERE gap > 0 OR t.a IS NOT NULL""")
def duplicate_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between tracks; those that overlap only where one body was seen twice are bridged too."""
    b = _boxes(spark, d)
    twice = _twice(b)
    spans = b.groupBy("game", "m", F.floor(F.col("f") / 5000).alias("part")).agg(F.min("f").alias("s"), F.max("f").alias("e"))
    out = detection.gaps(spans, ["game"], "m", "s", "e", twice)
    return out.join(twice.select("game", "a", "b", F.lit(True).alias("twice")), ["game", "a", "b"], "left").withColumn("twice", F.coalesce("twice", F.lit(False)))


_LOOKS = "parts AS (SELECT *, player * 1000 + rally // 2 AS m FROM touches), gallery AS (SELECT game, m, embedding::DOUBLE[] AS v, touch_id % 4 AS bin FROM parts JOIN embeddings ON vec_id = (player * 5) % 100)"


def _looks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A player's touches of two rallies as a tracklet m, and for each touch a vector, the same for all touches of a player."""
    p = touches(spark, d).withColumn("m", F.col("player") * 1000 + F.floor(F.col("rally") / 2))
    e = table(spark, d, "embeddings").where("vec_id < 100").select("vec_id", "embedding")
    return p, p.select("game", "m", "touch_id", ((F.col("player") * 5) % 100).alias("vec_id"), (F.col("touch_id") % 4).alias("bin")).join(e, "vec_id")


@query(f"""WITH {TOUCHES}, {_LOOKS}, spans AS (SELECT game, m, min(frame) AS s, max(frame) AS e, count(*) AS n, count(*) FILTER (x < 9.0) AS l FROM parts GROUP BY ALL),
zones AS (SELECT game, m, CAST(floor(x / 3) AS INT) AS z, count(*) AS n FROM parts GROUP BY ALL),
shared AS (SELECT a.game, a.m AS a, b.m AS b, sum(least(a.n / s.n, b.n / t.n)) AS o FROM zones a JOIN zones b ON a.game = b.game AND a.z = b.z AND a.m < b.m JOIN spans s ON s.game = a.game AND s.m = a.m JOIN spans t ON t.game = b.game AND t.m = b.m GROUP BY ALL),
means AS (SELECT a.game, a.m AS a, b.m AS b, avg(least(1.0, greatest(0.0, least(1.0, (1 - list_dot_product(a.v, b.v)) / 2)) + 0.2 * abs(a.bin - b.bin) / 3)) AS distance FROM gallery a JOIN gallery b ON a.game = b.game AND a.m < b.m GROUP BY ALL)
SELECT game, a, b, round(distance, 5) AS distance FROM means d JOIN spans s USING (game) JOIN spans t USING (game) LEFT JOIN shared USING (game, a, b)
WHERE s.m = a AND t.m = b AND greatest(s.s - t.e, t.s - s.e) > 0 AND 1 - coalesce(o, 0) <= 0.95 AND NOT ((s.l >= s.n - s.l) <> (t.l >= t.n - t.l) AND greatest(s.l, s.n - s.l) / s.n >= 0.7 AND greatest(t.l, t.n - t.l) / t.n >= 0.7) AND distance <= 0.34""")
def candidate_matches_by_look(spark: SparkSession, d: str) -> DataFrame:
    """Tracklets of a game that may be one player, where each player has a look of their own."""
    p, gallery = _looks(spark, d)
    p = p.withColumns({"zone": F.floor(F.col("x") / 3).cast("int"), "side": F.when(F.col("x") < 9.0, "A").otherwise("B")})
    spans = p.groupBy("game", "m").agg(F.min("frame").alias("s"), F.max("frame").alias("e"))
    return detection.candidate_matches(spans, p, gallery, ["game"], "m", "s", "e", "zone", "side", "embedding", "bin").withColumn("distance", F.round("distance", 5))


def tracklets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Boxes and vectors of tracklets: a player's touches of two rallies, a frame being ten minutes; every seventh game is not calibrated."""
    p, gallery = _looks(spark, d)
    w = Window.partitionBy("game", "m", F.floor(F.col("frame") / 600)).orderBy("touch_id")
    once = p.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    court = lambda c: F.when(F.col("game") % 7 != 6, c)
    x, y = F.col("x") * 100, F.col("y") * 60
    boxes = once.select("game", F.col("m").alias("track"), F.floor(F.col("frame") / 600).alias("frame"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 150).alias("y2"), court(F.col("x")).alias("u"), court(F.col("y")).alias("v"))
    return boxes, gallery.select("game", F.col("m").alias("track"), F.col("bin").alias("shape"), (F.col("touch_id") % 5).alias("isolation"), F.col("embedding").alias("vector"))


@query()
def player_identities(spark: SparkSession, d: str) -> DataFrame:
    """Every tracklet's identity: the cheapest merge of a game first, costs computed anew after each."""
    return identity.consolidated(*tracklets(spark, d), "game", "track", "frame", 2000.0).select("game", "track", "cluster", F.round("cost", 6).alias("cost"))


@query()
def roster_identities(spark: SparkSession, d: str) -> DataFrame:
    """Identities after the roster cap of two a side: merged under the relaxed bar, or likely no players."""
    boxes, vectors = tracklets(spark, d)
    found = identity.consolidated(boxes, vectors, "game", "track", "frame", 2000.0)
    return identity.rostered(boxes, vectors, found, "game", "track", "frame", 2000.0, players=2)
