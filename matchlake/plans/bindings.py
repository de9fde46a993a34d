"""The tracking model on the driver's tables, in Spark and as SQL with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.operators import ordered

#: Seconds without a touch that end a rally.
RALLY_GAP = 10_800
TYPES = {"view": "serve", "signup": "set", "purchase": "spike", "click": "dig", "error": "block"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: game, player, frame, touch_id, action_type, x, y, speed, height, rally."""
    e = table(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(v) for kv in TYPES.items() for v in kv])
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.floor(F.col("user_id") / 5).cast("long").alias("game"),
        F.col("user_id").alias("player"),
        seconds("ts").alias("frame"),
        F.col("event_id").alias("touch_id"),
        F.coalesce(kinds[F.col("event_type")], F.lit("hit")).alias("action_type"),
        (F.col("value") % 18.0).alias("x"),
        (k / 11.0).alias("y"),
        (F.col("value") / 10.0).alias("speed"),
        F.when(k % 7 != 0, k / 25.0).alias("height"),
    )
    return ordered.sessions(rows, ["game"], ["frame", "touch_id"], F.col("frame"), RALLY_GAP, "rally")


_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " ELSE 'hit' END"
#: The same rows as a common table expression.
TOUCHES = f"""
raw AS (
  SELECT user_id // 5 AS game, user_id AS player, CAST(floor(epoch(ts)) AS BIGINT) AS frame, event_id AS touch_id, {_CASE} AS action_type,
         value % 18.0 AS x, CAST(json_extract(props, '$.k') AS INT) / 11.0 AS y, value / 10.0 AS speed,
         CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS INT) / 25.0 END AS height
  FROM events),
marked AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY game ORDER BY frame, touch_id) > {RALLY_GAP} THEN 1 ELSE 0 END AS starts FROM raw),
touches AS (SELECT * EXCLUDE (starts), CAST(sum(starts) OVER (PARTITION BY game ORDER BY frame, touch_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rally FROM marked)
"""


def rallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per game and rally: first and last frame, touches, the players' mean x at either end as sides, set number."""
    t = touches(spark, sf_dir)
    first, last = F.struct("frame", "touch_id"), F.struct("frame", "touch_id")
    side = lambda c: F.when(c < 9.0, "A").otherwise("B")
    return t.groupBy("game", "rally").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count("*").alias("n"), side(F.min_by("x", first)).alias("start_side"), side(F.max_by("x", last)).alias("end_side")).withColumn("set_index", F.floor(F.col("rally") / 4).cast("long"))


RALLIES = (
    TOUCHES
    + """,
rallies AS (
  SELECT game, rally, min(frame) AS start, max(frame) AS "end", count(*) AS n,
         CASE WHEN arg_min(x, (frame, touch_id)) < 9.0 THEN 'A' ELSE 'B' END AS start_side,
         CASE WHEN arg_max(x, (frame, touch_id)) < 9.0 THEN 'A' ELSE 'B' END AS end_side,
         rally // 4 AS set_index
  FROM touches GROUP BY game, rally)
"""
)
