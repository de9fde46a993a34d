"""Centroid clustering of integer vectors with Hamerly's bounds, exact to the last unit.

Vectors become integers (floor(scale * x)); centroids are integer too, being
componentwise floors of exact means.  Each vector keeps an upper bound of the
distance to its own centroid and a lower bound of that to the second nearest.
When centroids move, the upper bound grows by its centroid's drift and the
lower one shrinks by the largest drift of the others.  Where the upper bound
stays below the lower one, or below half the gap between its centroid and the
nearest other, the assignment can't have changed and no distance is computed;
else the upper bound is made exact, and if that doesn't settle it all distances
are computed in integers.  Bounds are rounded outwards, and only strict
inequalities settle, so ties always go to the smaller number.

Each round reads the vectors with their bounds once, from the shared folder,
and writes them with new bounds; the sums of the clusters are written beside
them, a row for each batch and cluster.  The table of the round before is then
deleted.  Only centroids (a fixed number) pass through the driver.

Defined cases: vectors that are null, of another length or hold a null or
non-finite component are left out; repeated vectors count each; rows without a
key can't be seeds unless rows with a key are too few (they come last);
with fewer vectors than centroids, each vector is one; an empty table gives an
empty result; other columns don't matter.  Scaled components of 2**26 or more
are an error, as sums would no longer be exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from matchlake.llm.kernels import tidy
from matchlake.llm.tables import fresh_path, remove

DIM, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
_LARGE = 1 << 26
#: Products of doubles are exact while DIM * (2 * largest component)**2 stays below 2**53.
_EXACT = 1 << 53


def usable(vector: str, dim: int) -> Column:
    """Whether a vector has dim components, none of them null or non-finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as int64; by matrix products in doubles where these are exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < _EXACT else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


_OUT, _IN = 1 + 1e-12, 1 - 1e-12


def first_bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of ties), upper bound of its distance and lower bound of the second nearest's."""
    d = squared(x, c)
    near = d.argmin(1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, near]) * _OUT
    if len(c) == 1:
        return near, upper, np.full(len(x), np.inf)
    d[rows, near] = np.iinfo(np.int64).max
    return near, upper, np.sqrt(d.min(1)) * _IN


class Moves:
    """What a change of centroids means for bounds: drifts, and half the gap from each centroid to the nearest other."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.new = new
        self.drift = np.sqrt(own_squared(old, new)) * _OUT
        gaps = squared(new, new).astype(np.float64)
        np.fill_diagonal(gaps, np.inf)
        self.half = np.sqrt(gaps.min(1)) / 2 * _IN
        order = np.argsort(self.drift)
        self.most = np.full(len(new), self.drift[order[-1]])
        self.most[order[-1]] = self.drift[order[-2]] if len(new) > 1 else 0.0

    def apply(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New assignments and bounds, and how many vectors needed all distances."""
        upper, lower, near = (upper + self.drift[near]) * _OUT, (lower - self.most[near]) - 1e-9, near.copy()
        lower = np.where(lower > 0, lower * _IN, lower)
        limit = np.maximum(lower, self.half[near])
        open_ = np.flatnonzero(~(upper < limit))
        upper[open_] = np.sqrt(own_squared(x[open_], self.new[near[open_]])) * _OUT
        open_ = open_[~(upper[open_] < limit[open_])]
        if len(open_):
            near[open_], upper[open_], lower[open_] = first_bounds(x[open_], self.new)
        return near, upper, lower, len(open_)


def _ints(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dim)


def seeds(vectors: DataFrame, key: str, n: int) -> np.ndarray:
    """The n vectors of the smallest sha256 of `2:<key>`; ties by the vectors themselves."""
    order = F.sha2(F.concat(F.lit("2:"), F.col(key).cast("string")).cast("binary"), 256)
    rows = vectors.select(order.alias("h"), "ints").orderBy(F.col("h").asc_nulls_last(), "ints").limit(n).collect()
    return np.array([r["ints"] for r in rows], np.int64)


def _floor_means(sums: dict[int, tuple[int, list[int]]], old: np.ndarray) -> np.ndarray:
    return np.array([[s // sums[k][0] for s in sums[k][1]] if k in sums else c for k, c in enumerate(old.tolist())], np.int64)


class _Table:
    """Vectors with bounds in the shared folder, and beside them the sums of their clusters."""

    def __init__(self, spark, key: T.StructField, dim: int):
        self.spark, self.path, self.dim = spark, fresh_path(spark), dim
        self.state = T.StructType([T.StructField("key", key.dataType), T.StructField("ints", T.ArrayType(T.IntegerType())), T.StructField("near", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())])
        self.schema = T.StructType([*self.state.fields, T.StructField("scanned", T.LongType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.LongType())), T.StructField("kind", T.StringType())])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.state).parquet(f"{self.path}/kind=row")

    def sums(self) -> tuple[dict[int, tuple[int, list[int]]], int]:
        """Per cluster the number of its vectors and the sums of their components; and the vectors that were scanned in full."""
        table = self.spark.read.schema(self.schema).parquet(self.path).where("kind = 'sum'")
        parts = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"t{j}") for j in range(self.dim)]
        found = table.groupBy("near").agg(F.sum("n").alias("n"), F.sum("scanned").alias("scanned"), *parts).collect()
        return {r["near"]: (r["n"], [int(r[f"t{j}"]) for j in range(self.dim)]) for r in found}, sum(r["scanned"] for r in found)

    def write(self, source: DataFrame, judge) -> None:
        """judge(batch, x) gives near, upper, lower and the number of full scans for the vectors x of a batch."""
        dim, schema = self.dim, self.schema
        kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}

        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                x = _ints(b.column("ints"), dim)
                if np.abs(x).max() >= _LARGE:
                    raise ValueError(f"scaled components of {_LARGE} or more")
                near, upper, lower, scanned = judge(b, x)
                order = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.diff(near[order], prepend=-1))
                total = np.add.reduceat(x[order], first, axis=0)
                n = np.diff(np.append(first, len(x)))
                clusters = near[order][first]
                m = len(clusters)
                made = {
                    "key": pa.concat_arrays([b.column("key"), pa.nulls(m, b.column("key").type)]),
                    "ints": pa.concat_arrays([b.column("ints").cast(kinds["ints"]), pa.nulls(m, kinds["ints"])]),
                    "near": pa.array(np.concatenate((near, clusters)), pa.int32()),
                    "upper": pa.array(np.concatenate((upper, np.zeros(m)))),
                    "lower": pa.array(np.concatenate((lower, np.zeros(m)))),
                    "scanned": pa.array([0] * len(x) + [scanned] + [0] * (m - 1), pa.int64()),
                    "n": pa.array(np.concatenate((np.zeros(len(x), np.int64), n))),
                    "total": pa.array([None] * len(x) + total.tolist(), kinds["total"]),
                    "kind": pa.array(["row"] * len(x) + ["sum"] * m, pa.string()),
                }
                yield pa.RecordBatch.from_arrays([made[f.name] for f in schema.fields], names=schema.names)

        source.mapInArrow(tidy(run), schema).write.partitionBy("kind").parquet(self.path)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS, told: list | None = None) -> DataFrame:
    """One row per usable vector: key, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    `told` gets, for each round after the first, how many vectors needed all distances.
    """
    spark = df.sparkSession
    ints = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("int"))
    fits = F.forall(F.col(vector), lambda c: F.abs(c.cast("double") * scale) < float(_LARGE))
    given = df.where(usable(vector, dim)).select(F.col(key).alias("key"), F.when(fits, ints).otherwise(F.raise_error(F.lit(f"scaled components of {_LARGE} or more"))).alias("ints"))
    now = seeds(given, "key", centroids)
    field = T.StructField("key", df.schema[key].dataType)
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not len(now):
        return given.select(F.col("key").alias(key), *(F.lit(None).cast(t).alias(n) for n, t in zip(names, ("int", "long", "long", "long", "string"), strict=True)))
    table = _Table(spark, field, dim)
    table.write(given, lambda b, x, c=now: (*first_bounds(x, c), len(x)))
    for _ in range(rounds):
        sums, _ = table.sums()
        new = _floor_means(sums, now)
        moves, after = Moves(now, new), _Table(spark, field, dim)

        def judge(b, x, moves=moves):
            return moves.apply(x, *(b.column(c).to_numpy() for c in ("near", "upper", "lower")))

        after.write(table.rows(), judge)
        remove(spark, table.path)
        table, now = after, new
        if told is not None:
            told.append(table.sums()[1])
    square = lambda a, c: F.aggregate(F.zip_with(a, c, lambda p, q: (p.cast("long") - q) * (p.cast("long") - q)), F.lit(0).cast("long"), lambda s, v: s + v)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    final = spark.createDataFrame([(k, c, d) for k, (c, d) in enumerate(zip(now.tolist(), digest, strict=True))], "near int, centre array<long>, centroid_sha256 string")
    placed = table.rows().join(F.broadcast(final), "near").select(F.col("key"), F.col("near").alias("cluster"), square(F.col("ints"), F.col("centre")).alias("distance"), "centroid_sha256")
    by = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    every = sum(r["cluster_inertia"] for r in by)
    inertia = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], every) for r in by], "cluster int, cluster_inertia long, inertia long")
    return placed.join(F.broadcast(inertia), "cluster").select(F.col("key").alias(key), *names)
