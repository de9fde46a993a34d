"""Intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables that the step at hand has written, where a step is one of `settled`.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this process if Spark runs inside it (tests), else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="matchlake-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/matchlake-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: its lineage ends there."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession)
    df.write.parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s result, saved; the tables that were saved on the way are then removed.

    Nothing else may read them later: make must not hand on a DataFrame but its result.
    """
    outer, token = _WRITTEN.get(), _WRITTEN.set([])
    try:
        done = saved(make())
        *before, last = _WRITTEN.get()
    finally:
        _WRITTEN.reset(token)
    for path in before:
        remove(spark, path)
    if outer is not None:
        outer.append(last)
    return done


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
