"""Connected components of a large edge list by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators.tables import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _forest(batches):
    """Edges that connect what each batch of edges connects, without its cycles: each node to its component's smallest."""
    for b in batches:
        nodes, ends = np.unique(np.concatenate([b.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
        i, j = ends[: len(b)], ends[len(b) :]
        label = np.arange(len(nodes))
        while True:
            p, q = label[i], label[j]
            if (p == q).all():
                break
            to = np.arange(len(nodes))
            np.minimum.at(to, np.maximum(p, q), np.minimum(p, q))
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
        own = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["u", "v"])


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node of its component.

    Nodes are integers.  Self loops, repeated and reversed edges are allowed; nulls are not.  A
    star's centre may have any number of neighbours: minima are aggregated
    before the shuffle, and the join back is one that Spark can split.  Each
    round is written to the shared folder, so lost executors cost one round.
    """
    given = edges.where("a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    now = saved(given.mapInArrow(_forest, "u long, v long").distinct())
    before = _state(now)
    for _ in range(limit):
        if not before[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select("v", "v").distinct())
