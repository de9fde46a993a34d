"""Streams of shuffled batches against the batch operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import graph, ordered
from matchlake.streaming import folds, sessions


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    folds.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, name, parts, make):
    """Each part is a file and a batch of its own, in order; then all that the stream gave."""
    schema = parts[0].schema
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(map(str, (tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())))


def rows(seed, n=160):
    rng = random.Random(seed)
    made = [(f"g{k % 2}", 10**6 + 60 * k, k, rng.choice(["A", "B", None]), rng.choice([None, k // 9 % 5, k // 7 % 6]), rng.choice([None, k // 5 % 4]), rng.choice([None, 1.0, 2.0]), [rng.choice([-1.0, 1.0]), rng.random()] if rng.random() < 0.8 else None) for k in range(n)]
    return made


DDL = "game string, s long, n long, winner string, left int, right int, strength double, look array<double>"


def frame(spark, data):
    return spark.createDataFrame(data, DDL).withColumn("time", F.timestamp_seconds("s")).drop("s")


def parts(spark, seed):
    """Rows shuffled within an hour, in three batches; one row comes much too late; an end that moves the watermark on."""
    rng = random.Random(seed)
    data = rows(seed)
    jumbled = sorted(data, key=lambda r: r[1] + rng.uniform(0, 1500))
    late = ("g0", 10**6 + 60, 999, "A", 1, 1, 9.0, [1.0, 0.0])
    end = [(g, 10**7, 10**6, None, None, None, None, None) for g in ("g0", "g1")]
    cut = len(jumbled) // 3
    return data, [frame(spark, jumbled[:cut]), frame(spark, jumbled[cut : 2 * cut]), frame(spark, [*jumbled[2 * cut :], late]), frame(spark, end), frame(spark, [(*end[0][:1], 10**7 + 9 * 10**5, *end[0][2:])])]


@pytest.mark.parametrize("which", ["momentum", "scoreboard", "chained", "separated"])
def test_shuffled_batches_give_the_batch_result(rocks, tmp_path, which):
    data, batches = parts(rocks, 5)
    whole = frame(rocks, data)
    make, want = {
        "momentum": (
            lambda df: folds.momentum(df, ["game"], "time", "n", "winner", "A", "B", late="30 minutes"),
            lambda: ordered.running_differential(whole, ["game"], ["n"], F.col("winner") == "A", F.col("winner") == "B").select("game", "time", "n", "momentum"),
        ),
        "scoreboard": (
            lambda df: folds.scoreboard(df, ["game"], "time", "n", "left", "right", late="30 minutes"),
            lambda: graph.scoreboard(whole, "game", "n", "left", "right").join(whole.select("game", "n", "time"), ["game", "n"]).select("game", "time", "n", "winner", "set_index"),
        ),
        "chained": (
            lambda df: folds.chained(df, ["game"], "time", "n", "look", gap=9, gallery=2, late="30 minutes"),
            lambda: graph.chained(whole.withColumn("track", F.lit(1)), "game", "track", "n", "look", gap=9, gallery=2).join(whole.select("game", "n", "time"), ["game", "n"]).select("game", "time", "n", "part"),
        ),
        "separated": (
            lambda df: folds.separated(df, ["game"], "time", "strength", 200.0, late="30 minutes"),
            lambda: ordered.separated(whole.withColumn("t", F.unix_seconds("time")), ["game"], "t", "strength", 200.0).select("game", F.timestamp_seconds("t").alias("time"), "strength"),
        ),
    }[which]
    got = [r for r in streamed(rocks, tmp_path, which, batches, make) if "1970, 4, 26" not in r and "1970, 5, 6" not in r]
    assert got == sorted(map(str, (tuple(r) for r in want().collect()))) and len(got) > 20


def test_needs_rocksdb(spark):
    with pytest.raises(ValueError):
        folds.momentum(spark.readStream.format("rate").load().withColumn("g", F.lit(1)), ["g"], "timestamp", "value", "g", "a", "b")


def test_dense_windows(spark, tmp_path):
    data = spark.createDataFrame([("a", 60 * k) for k in (0, 1, 2, 9, 20, 21, 22, 23)] + [("b", 0)], "game string, s long").select("game", F.timestamp_seconds("s").alias("time"))
    end = spark.createDataFrame([("z", 10**7)], "game string, s long").select("game", F.timestamp_seconds("s").alias("time"))
    got = streamed(spark, tmp_path, "dense", [data, end, end], lambda df: sessions.dense_windows(df, ["game"], "time", "5 minutes", "5 minutes", 3))
    assert [r.split(", datetime")[0] + r.rsplit(",", 1)[1] for r in got] == ["('a' 3)", "('a' 4)"]
