"""Tables by job that are replaced job by job, all or nothing.

Each build writes the rows of the jobs that it made into a new version of the
data, and then a manifest that says in which version each job's rows are.
Readers go by the newest whole manifest.  So a job that now yields nothing has
no rows, whatever it had before; a build that fails, at any point, leaves the
table as it was; and a reader in the middle of a build sees the old one.

The manifest has (job_id, version, signature); a version of null says that the
job has no rows.  `clear` removes the versions that no manifest needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.operators.tables import remove

MANIFEST = "job_id string, version long, signature long"


def _numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """The numbers of the finished versions in a folder, ascending."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
    found = [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]
    return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}{n}/_SUCCESS")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole manifest; empty before the first build."""
    known = _numbers(spark, path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/{known[-1]}") if known else spark.createDataFrame([], MANIFEST)


def publish(rows: DataFrame | None, jobs: DataFrame, data: str, manifests: str, every: DataFrame | None = None) -> None:
    """Replaces the rows of `jobs` (job_id, signature) by `rows`, which has a job_id and rows of these jobs only.

    every: (job_id), the jobs that exist; others leave the manifest.  Jobs that
    are neither in jobs nor gone keep their rows.  rows is None where jobs only go.
    """
    spark = jobs.sparkSession
    used = [*_numbers(spark, manifests), *_numbers(spark, data, "version=")]
    now = max(used, default=0) + 1
    path = f"{data}/version={now}"
    if rows is not None:
        rows.withColumn("job_id", F.col("job_id").cast("string")).repartitionByRange("job_id").sortWithinPartitions("job_id").write.mode("overwrite").parquet(path)
    made = spark.read.parquet(path).select("job_id").distinct() if rows is not None else jobs.select("job_id").limit(0)
    some = made.withColumn("version", F.lit(now).cast("long"))
    given = jobs.select(F.col("job_id").cast("string").alias("job_id"), F.col("signature").cast("long").alias("signature")).distinct()
    old = manifest(spark, manifests).join(given, "job_id", "left_anti")
    if every is not None:
        old = old.join(every.select(F.col("job_id").cast("string").alias("job_id")).distinct(), "job_id", "left_semi")
    whole = old.unionByName(given.join(some, "job_id", "left").select("job_id", "version", "signature"))
    whole.write.mode("overwrite").parquet(f"{manifests}/{now}")


def current(spark: SparkSession, data: str, manifests: str) -> DataFrame | None:
    """The rows of all jobs as the newest manifest has them; None before the first build."""
    known = manifest(spark, manifests)
    live = [r[0] for r in known.where("version is not null").select("version").distinct().collect()] or _numbers(spark, data, "version=")[-1:]
    if not live:
        return None
    rows = spark.read.option("basePath", data).option("mergeSchema", "true").parquet(*[f"{data}/version={v}" for v in live])
    wanted = known.where("version is not null").select(F.col("job_id"), F.col("version"))
    return rows.withColumn("version", F.col("version").cast("long")).join(wanted, ["job_id", "version"], "left_semi").drop("version")


def clear(spark: SparkSession, data: str, manifests: str) -> None:
    """Removes all versions and manifests that the newest manifest doesn't need; not while others read or build."""
    known = _numbers(spark, manifests)
    live = {r[0] for r in manifest(spark, manifests).where("version is not null").select("version").distinct().collect()}
    versions = _numbers(spark, data, "version=")
    for v in versions[:-1]:
        if v not in live:
            remove(spark, f"{data}/version={v}")
    for v in known[:-1]:
        remove(spark, f"{manifests}/{v}")
