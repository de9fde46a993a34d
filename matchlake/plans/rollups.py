"""Rosters, teams, games, galleries and upserts on the driver's tables: nation is a team, a customer a player, an order a game."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import scalars
from matchlake.operators import graph, ordered, ranks, stats, upserts, vectors
from matchlake.plans.bindings import TOUCHES, seconds, table, touches

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


@query("""SELECT c_nationkey AS team, c_custkey AS player, count(o_orderkey) AS games, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def roster_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Every member of every roster, also those without games."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    own = o.groupBy("o_custkey").agg(F.count("*").alias("games"), F.sum("o_totalprice").alias("total"))
    out = c.join(own, c["c_custkey"] == own["o_custkey"], "left")
    return out.select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("player"), F.coalesce("games", F.lit(0)).alias("games"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("""WITH g AS (SELECT o_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT c_nationkey AS team, count(*) AS games, count(*) FILTER (a > b) AS wins, count(*) FILTER (b > a) AS losses FROM g JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def team_records(spark: SparkSession, d: str) -> DataFrame:
    """Wins and losses of a team over its games; ties count for neither."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") == "A").alias("b"))
    games = table(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return games.groupBy(F.col("c_nationkey").alias("team")).agg(F.count("*").alias("games"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("b") > F.col("a")).alias("losses"))


@query("""SELECT c_nationkey AS team, o_orderpriority AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def team_mix(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("team"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS player FROM customer ANTI JOIN orders ON c_custkey = o_custkey""")
def roster_without_games(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("player"))


@query("""SELECT c_nationkey AS team, count(*) AS rich FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey GROUP BY ALL""")
def members_with_big_games(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 200000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy(F.col("c_nationkey").alias("team")).agg(F.count("*").alias("rich"))


@query("""SELECT o_orderkey AS game, o_custkey AS player, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3""")
def latest_games(spark: SparkSession, d: str) -> DataFrame:
    """Each player's three latest games."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    out = table(spark, d, "orders").select(F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("player"), F.row_number().over(w).cast("long").alias("place"))
    return out.where("place <= 3")


@query("""SELECT o_orderkey AS game, o_orderstatus AS status, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50""")
def games_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 games by status, then newest first."""
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    first = table(spark, d, "orders").withColumn("_rank", rank).orderBy("_rank", F.desc("o_orderdate"), "o_orderkey").limit(50)
    w = Window.orderBy("_rank", F.desc("o_orderdate"), "o_orderkey")
    return first.select(F.col("o_orderkey").alias("game"), F.col("o_orderstatus").alias("status"), F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT o_orderkey AS game, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1995-06-30' AND o_orderstatus IN ('O', 'F')""")
def games_by_date(spark: SparkSession, d: str) -> DataFrame:
    """Games of a period by calendar day, and of two statuses."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").where(day.between("1995-01-01", "1995-06-30") & F.col("o_orderstatus").isin("O", "F")).select(F.col("o_orderkey").alias("game"), day.alias("day"))


@query("""SELECT c_custkey AS player, trim(c_name) AS name FROM customer WHERE contains(lower(c_name), lower(trim('  R#00000001 ')))""")
def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive substring search."""
    return table(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lower(F.trim(F.lit("  R#00000001 "))))).select(F.col("c_custkey").alias("player"), F.trim("c_name").alias("name"))


@query("""SELECT min(name) AS name FROM (SELECT trim(source) AS name, 0 AS part FROM documents UNION ALL SELECT upper(trim(source)), 1 FROM documents) WHERE part = 0 GROUP BY lower(name)""")
def roster_union(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive union of two rosters; the first one's spelling stays."""
    a = table(spark, d, "documents").select(F.col("source").alias("name"))
    return upserts.union_ignoring_case([a, a.select(F.upper("name").alias("name"))], "name")


@query("""WITH s AS (SELECT DISTINCT source FROM documents), n AS (SELECT source, try_cast(regexp_extract(source, '\\d+') AS INT) AS k FROM s) SELECT source, row_number() OVER (ORDER BY k IS NULL, k, source) AS place FROM n""")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Names by the number in them, then those without."""
    n = table(spark, d, "documents").select("source").distinct().withColumn("k", F.expr("try_cast(regexp_extract(source, '\\\\d+', 0) as int)"))
    return ranks.ranked(n, F.col("k").isNull(), "k", "source").select("source", (F.col("place") + 1).alias("place"))


@query("""WITH base AS (SELECT c_custkey AS id, c_mktsegment AS name FROM customer), ch AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'renamed' END AS name FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 50 = 0)
SELECT * FROM base WHERE id NOT IN (SELECT id FROM ch) UNION ALL SELECT * FROM ch WHERE trim(name) <> ''""")
def name_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Names with changes laid over them; blank ones delete."""
    c = table(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    changes = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, "").otherwise("renamed").alias("name"))
    changes = changes.union(c.where("c_custkey % 50 = 0").select((-F.col("c_custkey")).alias("id"), F.lit("new").alias("name")))
    return upserts.upserted(base, changes, ["id"], scalars.named(F.col("name")).isNull())


@query(f"""WITH {TOUCHES}, p AS (SELECT game, rally // 16 AS part, min(frame) AS s, max(frame) - min(frame) + 1 AS duration FROM touches GROUP BY ALL)
SELECT game, part, duration, CAST(coalesce(sum(duration) OVER (PARTITION BY game ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p""")
def segment_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a game laid end to end."""
    p = touches(spark, d).groupBy("game", F.floor(F.col("rally") / 16).alias("part")).agg((F.max("frame") - F.min("frame") + 1).alias("duration"))
    return upserts.concatenated(p, "game", "part", "duration")


@query("""WITH g AS (SELECT label AS name, embedding AS g FROM embeddings WHERE vec_id % 2 = 0), q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 50 = 1),
e AS (SELECT vec_id, name, min(1 - list_dot_product(embedding::DOUBLE[], g::DOUBLE[])) AS dist FROM q CROSS JOIN g GROUP BY ALL), r AS (SELECT *, lead(dist) OVER (PARTITION BY vec_id ORDER BY dist, name) AS second, row_number() OVER (PARTITION BY vec_id ORDER BY dist, name) AS n FROM e)
SELECT vec_id, name, round(dist, 5) AS distance FROM r WHERE n = 1 AND dist <= 0.8 AND (second IS NULL OR second - dist >= 0.02)""")
def gallery_match(spark: SparkSession, d: str) -> DataFrame:
    """Query vectors (every 50th) against the whole gallery of even ids, with a margin to the second name."""
    e = table(spark, d, "embeddings").withColumn("all", F.lit(0))
    gallery = e.where("vec_id % 2 = 0").select("all", F.col("label").alias("name"), "embedding")
    out = vectors.gallery_match(e.where("vec_id % 50 = 1").select("all", "vec_id", "embedding"), gallery, "vec_id", "embedding", "name", ["all"], 0.8, 0.02)
    return out.select("vec_id", "name", F.round("distance", 5).alias("distance"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 = 0) SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(greatest(0.0, least(1.0, (1 - list_dot_product(a.v, b.v)) / 2)), 5) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id""")
def appearance_distances(spark: SparkSession, d: str) -> DataFrame:
    """Half cosine distances inside a label."""
    e = table(spark, d, "embeddings").where("vec_id % 7 = 0")
    a, b = e.select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "label").where("a < b").select("label", "a", "b", F.round(scalars.half_cosine_distance(F.col("x"), F.col("y")), 5).alias("distance"))


@query("""WITH g AS (SELECT label AS name, embedding AS g FROM embeddings WHERE vec_id % 2 = 0), q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 1),
e AS (SELECT vec_id, name, min(1 - list_dot_product(embedding::DOUBLE[], g::DOUBLE[])) AS dist FROM q CROSS JOIN g GROUP BY ALL), r AS (SELECT *, lead(dist) OVER (PARTITION BY vec_id ORDER BY dist, name) AS second, row_number() OVER (PARTITION BY vec_id ORDER BY dist, name) AS n FROM e)
SELECT vec_id, name, round(dist, 5) AS distance FROM r WHERE n = 1 AND dist <= 0.8 AND (second IS NULL OR second - dist >= 0.02)""")
def gallery_match_all(spark: SparkSession, d: str) -> DataFrame:
    """All query vectors (odd ids) against the whole gallery of even ids, with a margin to the second name."""
    e = table(spark, d, "embeddings").withColumn("all", F.lit(0))
    gallery = e.where("vec_id % 2 = 0").select("all", F.col("label").alias("name"), "embedding")
    out = vectors.gallery_match(e.where("vec_id % 2 = 1").select("all", "vec_id", "embedding"), gallery, "vec_id", "embedding", "name", ["all"], 0.8, 0.02)
    return out.select("vec_id", "name", F.round("distance", 5).alias("distance"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(greatest(0.0, least(1.0, (1 - list_dot_product(a.v, b.v)) / 2)), 5) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id""")
def appearance_distances_all(spark: SparkSession, d: str) -> DataFrame:
    """Half cosine distances of all pairs inside a label."""
    pairs = vectors.similar_pairs(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")
    away = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("s")) / 2))
    return pairs.select("label", "a", "b", (F.floor(away * 1e5 + 0.5) / 1e5).alias("distance"))  # F.round makes a decimal of each


@query()
def identity_cliques(spark: SparkSession, d: str) -> DataFrame:
    """Groups of vectors of a label that are pairwise similar."""
    return graph.clique_groups(vectors.similar_pairs(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.9), "label", "a", "b", "s")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 5) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) > 0.2""")
def look_alikes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of a label that are a little alike."""
    return vectors.similar_pairs(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.2).withColumn("s", F.round("s", 5))


@query()
def look_alike_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of vectors of a label that are pairwise a little alike, the most alike joined first."""
    return graph.clique_groups(vectors.similar_pairs(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.2), "label", "a", "b", "s")


@query()
def identity_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Tracklets of a game merged by appearance where they don't overlap in time."""
    e = table(spark, d, "embeddings").withColumn("start", F.col("vec_id") * 3).withColumn("end", F.col("vec_id") * 3 + 20)
    return graph.agglomerated(e, "label", "vec_id", "embedding", 0.2)


@query()
def scoreboard_fsm(spark: SparkSession, d: str) -> DataFrame:
    """Winners and sets from scoreboard readings with unread sides and resets."""
    t = touches(spark, d)
    n = F.row_number().over(Window.partitionBy("game").orderBy("frame", "touch_id")) - 1
    r = t.select("game", "touch_id", n.alias("n"), "x")
    up = F.sum((F.col("x") < 9.0).cast("int")).over(Window.partitionBy("game", F.floor(F.col("n") / 20)).orderBy("n"))
    r = r.withColumn("left", up).withColumn("right", F.col("n") % 20 + 1 - up)
    r = r.select("game", "n", F.when(F.col("n") % 7 != 0, F.col("left")).alias("left"), F.when(F.col("n") % 11 != 0, F.col("right")).alias("right"))
    return graph.scoreboard(r, "game", "n", "left", "right")


@query("""WITH l AS (SELECT quality, toxic FROM labels) SELECT quality, toxic, count(*) AS n FROM l GROUP BY ALL""")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    return stats.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY ALL) SELECT quality, round((SELECT count(*) FROM labels) / (2 * greatest(1, n)), 6) AS weight FROM c""")
def label_weights(spark: SparkSession, d: str) -> DataFrame:
    return stats.class_weights(table(spark, d, "labels"), "quality", 2).withColumn("weight", F.round("weight", 6))


@query("""SELECT CASE WHEN count(value) >= 30 THEN round(greatest(0.0, avg(value) - 1.5 * stddev_pop(value)), 6) END AS low, CASE WHEN count(value) >= 30 THEN round(avg(value) + 1.5 * stddev_pop(value), 6) END AS high FROM events""")
def plausible_range(spark: SparkSession, d: str) -> DataFrame:
    return stats.plausible_range(table(spark, d, "events"), "value").select(r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query(f"""WITH {TOUCHES}, s AS (SELECT game, list_sort(list(speed)) AS v FROM touches GROUP BY game) SELECT game, v[CAST(floor(0.95 * (len(v) - 1)) AS INT) + 1] AS p95, v[len(v) // 2 + 1] AS middle, round(0.5 * list_median(v), 6) AS floor FROM s""")
def speed_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by truncated index, the upper middle value, and half the median."""
    s = F.sort_array(F.collect_list("speed"))
    out = touches(spark, d).groupBy("game").agg(stats.truncated_percentile("speed", 0.95).alias("p95"), s.alias("v"), r6(0.5 * F.median("speed"), "floor"))
    return out.select("game", "p95", F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("middle"), "floor")


@query("""WITH m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM conversations), i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS island FROM m)
SELECT conv_id, CAST(island AS BIGINT) AS island, any_value(role) AS role, min(turn) AS "start", max(turn) AS "end" FROM i GROUP BY conv_id, island""")
def status_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one role in a conversation as labelled segments."""
    out = ordered.islands(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    return out.groupBy("conv_id", F.col("island").cast("long").alias("island")).agg(F.min("role").alias("role"), F.min("turn").alias("start"), F.max("turn").alias("end"))


@query("""SELECT l_orderkey AS game, l_partkey AS id, bool_or(good) AS plausible, count(*) AS n FROM (SELECT *, l_quantity < 25 AS good, max(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS any_good FROM lineitem) WHERE good OR any_good = 0 GROUP BY ALL""")
def plausible_or_all(spark: SparkSession, d: str) -> DataFrame:
    """Plausible rows of each game, or all if it has none."""
    out = stats.any_else_all(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity") < 25)
    return out.groupBy(F.col("l_orderkey").alias("game"), F.col("l_partkey").alias("id")).agg(F.bool_or(F.col("l_quantity") < 25).alias("plausible"), F.count("*").alias("n"))


@query("""SELECT l_orderkey AS game, l_linenumber AS line, round(greatest(0.0, least(1.0, 1 - abs(l_quantity - 25) / 20)), 6) AS held, CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag ELSE 'other' END AS kind, round(1 - (1 - l_discount) * (1 - l_tax), 6) AS either, round(greatest(0.0, 10 - l_quantity, l_quantity - 40), 6) AS outside, CAST(round_even(l_extendedprice / 100, 0) AS BIGINT) AS hundreds FROM lineitem WHERE l_quantity BETWEEN 5 AND 45""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").where(q.between(5, 45)).select(
        F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("line"), r6(scalars.clamp01(1 - F.abs(q - 25) / 20), "held"), scalars.normalised(F.col("l_returnflag"), ["R", "A"], "other").alias("kind"),
        r6(scalars.noisy_or(F.col("l_discount"), F.col("l_tax")), "either"), r6(scalars.outside(q, F.lit(10.0), F.lit(40.0)), "outside"), F.bround(F.col("l_extendedprice") / 100, 0).cast("long").alias("hundreds"),
    )


_BOX_A = "l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 10 AS x2, l_discount * 100 + 5 AS y2"


@query(f"""WITH b AS (SELECT l_orderkey AS game, l_linenumber AS line, {_BOX_A} FROM lineitem), p AS (SELECT a.game, a.line AS a, c.line AS b, greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i FROM b a JOIN b c ON a.game = c.game AND a.line < c.line),
s AS (SELECT game, a, b, i / (100 - i) AS iou FROM p WHERE i / (100 - i) >= 0.1), r AS (SELECT *, row_number() OVER (PARTITION BY game, a ORDER BY round(iou, 9) DESC, b) AS n FROM s) SELECT game, a, b, round(iou, 6) AS score FROM r WHERE n = 1""")
def best_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Each box's best overlapping later box of its game, by intersection over union of at least 0.1."""
    box = lambda p: [F.col("l_quantity").alias(p + "1"), (F.col("l_discount") * 100).alias(p + "2"), (F.col("l_quantity") + 10).alias(p + "3"), (F.col("l_discount") * 100 + 5).alias(p + "4")]
    from matchlake.operators import spatial

    l = table(spark, d, "lineitem")
    a, b = l.select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("a"), *box("p")), l.select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("b"), *box("q"))
    iou = scalars.iou(tuple(F.col(f"p{k}") for k in range(1, 5)), tuple(F.col(f"q{k}") for k in range(1, 5)))
    out = spatial.best_overlap(a, b, ["game"], "a", F.round(F.when(F.col("a") < F.col("b"), iou), 9), "b", 0.1)
    return out.withColumn("score", F.round("score", 6))


@query("""SELECT o_orderkey AS game, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS played_at, o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AS incomplete FROM orders WHERE o_totalprice > 100000""")
def incomplete_games(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("game"), seconds("o_orderdate").alias("played_at"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F")).alias("incomplete"))
