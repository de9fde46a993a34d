"""Readers of a game's logs as typed DataFrames, and writers.

Every reader takes a glob, so one scan reads all games of a store; `job_id` is
the name of a document's folder.  Paths may be in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.sources import movies, schemas, versions


def _job():
    return F.element_at(F.split(F.input_file_name(), "/"), -2)


def document(spark: SparkSession, glob: str, ddl: str) -> DataFrame:
    """Whole-file JSON documents of a schema with their job_id; no rows if no file fits. Files that aren't JSON are left out."""
    schema = T.StructType.fromDDL(ddl)
    kept = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    try:
        rows = spark.read.schema(kept).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(glob)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("job_id", T.StringType()), *schema.fields]))
    return rows.withColumn("job_id", _job()).where("_bad is null").select("job_id", *schema.fieldNames())


def preferred(first: DataFrame, second: DataFrame, key: str = "job_id") -> DataFrame:
    """All rows of `first`, and those of `second` for the keys that `first` lacks."""
    other = next(c for c in first.columns if c != key)
    there = first.groupBy(key).agg(F.count(other).alias("_n")).where("_n >= 0").select(key)  # reads a column, so that broken documents are told apart
    return first.unionByName(second.join(there, key, "left_anti"))


def rallies(spark: SparkSession, glob: str) -> DataFrame:
    """One row per rally with its position; jobs without rallies have none."""
    d = document(spark, glob, schemas.STATUS)
    return d.select("job_id", "fps", F.posexplode("rallies").alias("position", "r")).select("job_id", "fps", "position", "r.*")


def positions(spark: SparkSession, glob: str) -> DataFrame:
    """One row per player and frame; `ground` is the foot point, else the box centre's place (empty arrays count as none)."""
    d = document(spark, glob, schemas.POSITIONS).select("job_id", "frame_idx", "timestamp_s", F.explode("players").alias("p"))
    has = lambda c: F.when(F.size(c) > 0, F.col(c))
    return d.select("job_id", "frame_idx", "timestamp_s", "p.*").withColumn("ground", F.coalesce(has("court_ground"), has("court")))


def actions(spark: SparkSession, grouped_glob: str, raw_glob: str) -> DataFrame:
    """Touches of each job: the grouped log where it exists, else the raw one."""
    return preferred(document(spark, grouped_glob, schemas.ACTIONS), document(spark, raw_glob, schemas.ACTIONS))


def names(spark: SparkSession, glob: str) -> DataFrame:
    """(job_id, stable_id, name) of JSON objects from id to name; blank names are left out."""
    text = spark.read.text(glob, wholetext=True).withColumn("job_id", _job())
    rows = text.select("job_id", F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("stable_id", "name"))
    return rows.select("job_id", F.col("stable_id").cast("long").alias("stable_id"), F.trim("name").alias("name")).where("length(name) > 0")


def ignored(spark: SparkSession, glob: str) -> DataFrame:
    """(job_id, stable_id), distinct, of JSON lists of ids."""
    text = spark.read.text(glob, wholetext=True).withColumn("job_id", _job())
    return text.select("job_id", F.explode(F.from_json("value", T.ArrayType(T.LongType()))).alias("stable_id")).distinct()


def with_defaults(saved, defaults: dict[str, str]):
    """A map column of saved settings over defaults: a saved null overrides a default, an absent key does not."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.when(saved.isNull(), base).otherwise(F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(saved, k)), saved))


def jobs(spark: SparkSession, glob: str) -> DataFrame:
    """Job documents; corrupt ones are left out, interrupted ones become errors."""
    d = document(spark, glob, schemas.JOB)
    broken = F.col("status").isin("queued", "processing", "running")
    return d.withColumn("error", F.when(broken, F.coalesce("error", F.lit("interrupted"))).otherwise(F.col("error"))).withColumn("status", F.when(broken, "error").otherwise(F.col("status")))


def annotations(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of at least ten white-space separated tokens: track, box, frame, three flags and a label of what follows."""
    t = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: F.length(x) > 0)
    rows = spark.read.text(glob).select(t.alias("t"), _job().alias("job_id")).where("size(t) >= 10")
    number = lambda k: F.col("t")[k].cast("int")
    flag = lambda k: F.col("t")[k] == "1"
    label = F.regexp_replace(F.array_join(F.slice("t", 10, F.size("t")), " "), '"', "")
    return rows.select("job_id", number(0).alias("track_id"), F.array(*[number(k) for k in range(1, 5)]).alias("box"), number(5).alias("frame_id"), flag(6).alias("lost"), flag(7).alias("occluded"), flag(8).alias("generated"), label.alias("label"))


def boxes(spark: SparkSession, glob: str, classes: dict[int, int] | None = None) -> DataFrame:
    """Label lines of a class and at least four numbers; classes: those to keep and what they become."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(glob).select(t.alias("t"), F.input_file_name().alias("file")).where("size(t) >= 5")
    rows = rows.select("file", F.col("t")[0].cast("int").alias("class"), F.transform(F.slice("t", 2, F.size("t")), lambda x: x.cast("double")).alias("values"))
    if classes is not None:
        table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
        rows = rows.withColumn("class", table[F.col("class")]).where("class is not null")
    return rows


def image_tags(spark: SparkSession, glob: str, known: dict[str, str]) -> DataFrame:
    """(frame, label, known) of XML images by their first tag; labels are mapped, unknown ones kept as they are."""
    rows = spark.read.format("xml").option("rowTag", "image").schema("_id BIGINT, tag ARRAY<STRUCT<_label STRING>>").load(glob)
    raw = F.element_at("tag", 1)["_label"]
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return rows.where(F.size("tag") > 0).select(F.col("_id").alias("frame"), F.coalesce(table[raw], raw).alias("label"), F.map_contains_key(table, raw).alias("known"))


def stems(spark: SparkSession, glob: str) -> DataFrame:
    """(stem, suffix, path) of files, without reading them."""
    rows = spark.read.format("binaryFile").load(glob).select("path")
    return rows.select(F.regexp_extract("path", r"([^/]*)\.([^./]*)$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("suffix"), "path")


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and labels of the same stem."""
    return images.join(labels.select("stem", F.col("path").alias("label_path")), "stem")


def video_dates(spark: SparkSession, glob: str) -> DataFrame:
    """(path, created) of MP4 and MOV files of any size, by their headers only; created is null without a date."""
    movies.register(spark)
    return spark.read.format("movie_headers").load(glob).select("path", "created")


def ground_truth(rows: DataFrame, frames: int, width: str = "width", height: str = "height") -> DataFrame:
    """(frame, visible, cx, cy) of every frame up to `frames`, from percent boxes (frame, enabled, x, y, width, height); missing and disabled rows are not visible."""
    every = rows.sparkSession.range(1, frames + 1).select(F.col("id").alias("frame"))
    seen = rows.where("enabled").select("frame", (F.col("x") + F.col(width) / 2).alias("cx"), (F.col("y") + F.col(height) / 2).alias("cy"), F.lit(True).alias("_seen"))
    return every.join(seen, "frame", "left").select("frame", F.coalesce("_seen", F.lit(False)).alias("visible"), "cx", "cy")


def write_log(df: DataFrame, path: str) -> None:
    """The log as JSON by job, in place of what its jobs had; logs of other jobs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").json(path)


def signature(df: DataFrame):
    """One row by job: a hash of the files' names and times, to see whether a view over them is stale."""
    m = df.select(_job().alias("job_id"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    return m.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("p", F.unix_micros("t").alias("t")))).alias("files")).select("job_id", F.xxhash64("files").alias("signature"))


def stale(now: DataFrame, built: DataFrame) -> DataFrame:
    """The jobs of `now` whose signature differs from the built one, or is new; and those that are gone."""
    b = built.select("job_id", F.col("signature").alias("_old"))
    return now.join(b, "job_id", "full_outer").where("not (signature <=> _old)").select("job_id")


def refresh(now: DataFrame, view: str, signatures: str, build) -> DataFrame:
    """The view after the jobs whose signature changed were built anew and those that are gone removed.

    now: signature() of the logs.  build: (DataFrame of job_id, signature) -> the view's
    rows of these jobs, with a job_id.  view and signatures: folders of the versions of rows and of their manifests,
    made at the first call (see `versions`).  Only changed jobs are computed and
    written; a job that now has no rows is empty; a build that fails leaves the view as it
    was and is repeated at the next call.
    """
    spark = now.sparkSession
    built = versions.manifest(spark, signatures).select("job_id", "signature")
    changed = stale(now, built)
    fresh = now.join(changed, "job_id", "left_semi")
    if changed.limit(1).count():
        versions.publish(build(fresh) if fresh.limit(1).count() else None, fresh, view, signatures, now)
    rows = versions.current(spark, view, signatures)
    return rows if rows is not None else build(fresh).limit(0)


def heights(spark: SparkSession, glob: str) -> DataFrame:
    """(job_id, frame_idx, height_m) of the ball's log where its height is known."""
    return document(spark, glob, schemas.BALL).where("height_m is not null").select("job_id", "frame_idx", "height_m")


def write_galleries(df: DataFrame, path: str, track: str = "track", vector: str = "vector", least: int = 2) -> None:
    """Vectors by job, in place of all that its jobs had; tracks of fewer than `least` vectors are left out, jobs without others are then empty."""
    usable = df.where(F.col(vector).isNotNull()).groupBy("job_id", track).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    kept = df.join(usable.select("job_id", track), ["job_id", track], "left_semi")
    jobs = df.select("job_id", F.lit(None).cast("long").alias("signature")).distinct()
    versions.publish(kept, jobs, f"{path}/rows", f"{path}/manifests")


def galleries(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that write_galleries wrote, job_id as text."""
    rows = versions.current(spark, f"{path}/rows", f"{path}/manifests")
    if rows is None:
        raise ValueError(f"no galleries were written to {path}")
    return rows


def resumed(specs: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """The specs that have no report yet."""
    return specs.join(reports.select(key).distinct(), key, "left_anti")
