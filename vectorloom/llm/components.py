"""Connected components of an edge table, by alternating star steps.

A large-star step links every node's larger neighbours to its smallest one; a
small-star step links its smaller neighbours, and itself, to the smallest.  Both
keep the components.  When nothing changes, every node is linked to the
smallest node of its component alone.  Steps are joins and grouped minima; a
node with many neighbours is pre-aggregated on the map side, and its rows stay
on the join side that Spark can split.

An edge list within ``LOCAL_EDGES`` is settled in one pass over its 4 MB, as a
dozen rounds of tiny shuffles cost more time and more files than data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

LOCAL_EDGES = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node.

    Loops and repeated edges do no harm; without edges the result is empty.
    """
    current = cut_lineage(edges.select("a", "b").where("a != b").distinct())
    mark = _mark(current)
    if mark[0] <= LOCAL_EDGES:
        return _settled(current)
    while mark[0]:
        current = cut_lineage(_small_star(_large_star(current)))
        after = _mark(current)
        if after == mark:
            break
        mark = after
    pairs = current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())


def _settled(edges: DataFrame) -> DataFrame:
    """The same for a short edge list."""
    rows = edges.toArrow()
    a, b = (rows.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for name in ("a", "b"))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, root = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while True:
        low = root.copy()
        # Roots hook to the lower one of an edge, then all follow their roots.
        np.minimum.at(low, root[left], root[right])
        np.minimum.at(low, root[right], root[left])
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low, root):
            break
        root = low
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes[root], pa.int64())}))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digests of the edges; equal ones mean nothing moved."""
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
