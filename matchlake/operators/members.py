"""Rosters, names and members of a game: names onto statistics, shared frames, isolation and conflicts of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions import scalars


def with_names(stats: DataFrame, names: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """stats with the trimmed name of each key, in place of any name it had; null if the names lack it or it is blank."""
    known = names.select(*keys, scalars.named(F.col(name)).alias(name)).where(F.col(name).isNotNull())
    return stats.select(*[c for c in stats.columns if c.lower() != name.lower()]).join(known, keys, "left")


def listed_by_name(rows: DataFrame, name: str, value: str, order: list[str]) -> DataFrame:
    """(name, values): each trimmed name's values that aren't null, in order; blank names are left out."""
    kept = rows.where(F.col(value).isNotNull()).withColumn(name, scalars.named(F.col(name))).where(F.col(name).isNotNull())
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return kept.groupBy(name).agg(F.transform(items, lambda x: x["_value"]).alias("values"))


def ignored_changes(mostly_out: DataFrame, ignored: DataFrame, keys: list[str]) -> DataFrame:
    """All ignored keys, old and new, each once, with `newly`: it was not ignored before."""
    old = ignored.select(*keys).distinct()
    new = mostly_out.select(*keys).distinct().join(old, keys, "left_anti").withColumn("newly", F.lit(True))
    return old.withColumn("newly", F.lit(False)).unionByName(new)


def shared_frames(rows: DataFrame, keys: list[str], member: str, frame: str) -> DataFrame:
    """(keys, a, b, shared): how many frames two members are both in; pairs that share none are left out.

    Members meet in their frames, so a game costs the frames that members share.
    """
    once = rows.select(*keys, F.col(frame).alias("_f"), F.col(member).alias("_m")).distinct()
    a, b = once.withColumnRenamed("_m", "a"), once.withColumnRenamed("_m", "b")
    return a.join(b, [*keys, "_f"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def name_conflicts(rows: DataFrame, names: DataFrame, ignored: DataFrame, keys: list[str], member: str, frame: str, name: str = "name", time: str | None = None) -> DataFrame:
    """(keys, a, b, name, shared, first_frame): members of one trimmed name that are in frames together, without ignored ones.

    Names that differ in case are different names.  time: a column of rows; then
    also first_time, that of the first shared frame, to one place.
    """
    n = names.select(*keys, F.col(member).alias("_m"), scalars.named(F.col(name)).alias("_name")).where(F.col("_name").isNotNull())
    n = n.join(ignored.select(*keys, F.col(member).alias("_m")).distinct(), [*keys, "_m"], "left_anti")
    at = F.min(time if time else F.lit(None).cast("double")).alias("_t")
    named = rows.groupBy(*keys, F.col(member).alias("_m"), F.col(frame).alias("_f")).agg(at).join(n, [*keys, "_m"])
    a, b = named.withColumnRenamed("_m", "a"), named.drop("_t").withColumnRenamed("_m", "b")
    both = a.join(b, [*keys, "_name", "_f"]).where("a < b").groupBy(*keys, "a", "b", F.col("_name").alias(name))
    first = [F.round(F.min_by("_t", "_f").cast("double"), 1).alias("first_time")] if time else []
    return both.agg(F.count(F.lit(1)).alias("shared"), F.min("_f").alias("first_frame"), *first)


def names_checked(rows: DataFrame, names: DataFrame, changes: DataFrame, ignored: DataFrame, keys: list[str], member: str, frame: str, name: str = "name", time: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(after, refused): names (keys, member, name) with changes laid over them, save for keys where a change would give one name to two members seen at once.

    Only names that a changed member would bear are looked at, and only
    conflicts that such a member is in count: what was wrong before is no
    reason to refuse.  refused has these conflicts as name_conflicts gives
    them; of their keys no change is taken.  Members of a key are changed once.
    """
    base, new = names.select(*keys, member, name), changes.select(*keys, member, name)
    merged = base.join(new, [*keys, member], "left_anti").unionByName(new)
    touched = new.select(*keys, member).distinct()
    borne = new.select(*keys, scalars.named(F.col(name)).alias("_borne")).where("_borne is not null").distinct()
    asked = merged.withColumn("_borne", scalars.named(F.col(name))).join(borne, [*keys, "_borne"], "left_semi").drop("_borne")
    found = name_conflicts(rows, asked, ignored, keys, member, frame, name, time)
    either = [touched.select(*keys, F.col(member).alias(side), F.lit(True).alias(f"_{side}")) for side in "ab"]
    refused = found.join(either[0], [*keys, "a"], "left").join(either[1], [*keys, "b"], "left").where("_a or _b").select(*found.columns)
    taken = new.join(refused.select(*keys).distinct(), keys, "left_anti")
    return base.join(taken, [*keys, member], "left_anti").unionByName(taken), refused


def isolation(boxes: DataFrame, keys: list[str], box: str, x1: str, x2: str) -> DataFrame:
    """Adds `gap`, the distance of a box's centre to the nearest other one of its frame in own widths (null if alone), and its bucket `isolation`."""
    centre = (F.col(x1) + F.col(x2)) / 2
    w = Window.partitionBy(*keys).orderBy("_c", box)
    rows = boxes.withColumn("_c", centre)
    near = F.least(F.col("_c") - F.lag("_c").over(w), F.lead("_c").over(w) - F.col("_c"))
    rows = rows.withColumn("gap", near / F.greatest(F.lit(1.0), F.col(x2) - F.col(x1))).drop("_c")
    return rows.withColumn("isolation", scalars.isolation_bucket(F.col("gap")))


def conflicts(boxes: DataFrame, keys: list[str], box: str, corners: tuple[str, str, str, str]) -> DataFrame:
    """The boxes whose padded box meets another box of their frame as it is; so one of two may be in conflict and the other not."""
    o = boxes.select(*keys, F.col(box).alias("_id"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(corners)])
    meet = scalars.boxes_meet(scalars.padded(*[F.col(c) for c in corners]), tuple(F.col(f"_{k}") for k in range(4)))
    hit = boxes.join(o, keys).where((F.col("_id") != F.col(box)) & meet).select(*keys, box).distinct()
    return boxes.join(hit, [*keys, box], "left_semi")


def best_crops(boxes: DataFrame, keys: list[str], player: str, bucket: str, area: Column, tie: list[str], n: int = 1) -> DataFrame:
    """Each player's n best boxes: most isolated first, then the largest."""
    w = Window.partitionBy(*keys, player).orderBy(F.desc(bucket), F.desc(area), *tie)
    return boxes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def merged_boxes(boxes: DataFrame, clusters: DataFrame, keys: list[str], member: str, frame: str, area: Column) -> DataFrame:
    """The boxes of clusters (keys, member, cluster): one per cluster and frame, the larger one (of equals that of the smaller member)."""
    rows = boxes.join(clusters, [*keys, member])
    w = Window.partitionBy(*keys, "cluster", frame).orderBy(F.desc(area), member)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged_gallery(vectors: DataFrame, clusters: DataFrame, keys: list[str], member: str, bucket: str, isolation: str, tie: list[str], size: int = 10) -> DataFrame:
    """The vectors that clusters keep: of each shape bucket the `size` most isolated; where all are equally isolated, `size` evenly spaced ones in order."""
    rows = vectors.join(clusters, [*keys, member])
    w = Window.partitionBy(*keys, "cluster", bucket)
    rows = rows.withColumns({"_count": F.count(F.lit(1)).over(w), "_flat": F.min(isolation).over(w) == F.max(isolation).over(w), "_place": F.row_number().over(w.orderBy(*tie)) - 1, "_rank": F.row_number().over(w.orderBy(F.desc(isolation), *tie))})
    places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.bround(k * (F.col("_count") - 1) / F.lit(float(size - 1)), 0).cast("int"))
    keep = (F.col("_count") <= size) | F.when(F.col("_flat"), F.array_contains(places, F.col("_place").cast("int"))).otherwise(F.col("_rank") <= size)
    return rows.where(keep).drop("_count", "_flat", "_place", "_rank")


def summed_histograms(rows: DataFrame, clusters: DataFrame, keys: list[str], member: str, cell: str, count: str) -> DataFrame:
    """(keys, cluster, cell, count): the histograms of a cluster's members added."""
    return rows.join(clusters, [*keys, member]).groupBy(*keys, "cluster", cell).agg(F.sum(count).alias(count))


def review_list(groups: DataFrame, names: DataFrame, game: str) -> DataFrame:
    """(game, group, members, confidence, suggested_name, place): groups (game, node, group, confidence) from the largest and surest on.

    The suggested name is that of the smallest member that has one; names: (game, node, name).
    """
    known = names.select(game, "node", scalars.named(F.col("name")).alias("_name")).where(F.col("_name").isNotNull()).groupBy(game, "node").agg(F.min("_name").alias("_name"))
    rows = groups.join(known, [game, "node"], "left")
    whole = rows.groupBy(game, "group").agg(F.sort_array(F.collect_list("node")).alias("members"), F.max("confidence").alias("confidence"), F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("node"))).alias("suggested_name"))
    w = Window.partitionBy(game).orderBy(F.desc(F.size("members")), F.desc("confidence"), "group")
    return whole.withColumn("place", F.row_number().over(w).cast("long"))
