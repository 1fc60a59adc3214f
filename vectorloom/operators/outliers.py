"""Outlier scores with one row per sample: ``i, score, label``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import ints, matrix, table_batches
from ..errors import insufficient
from ..params import choice, float_param, int_param, seed_param
from ..session import cut_lineage
from . import preprocess
from .neighbors import CHUNK_ROWS, exploded, self_nearest
from .ordering import quantile_values
from .spectrum import second_moments

# Fixed value: share flagged when contamination is left open.
DEFAULT_SHARE = 0.01


def _scaled(df: DataFrame, params: dict, minimum: int = 2) -> tuple[DataFrame, preprocess.Scaler]:
    scaler = preprocess.fit(df, choice(params, "preprocess", "standardized", preprocess.MODES))
    if scaler.rows < minimum:
        raise insufficient(minimum, scaler.rows)
    return scaler.apply(df).select("i", "features"), scaler


def _share(params: dict) -> float | None:
    share = float_param(params, "contamination", DEFAULT_SHARE, 0.0, 0.5)
    return share if share > 0 else None


def _label_above(scored: DataFrame, share: float, rows: int) -> DataFrame:
    edge = quantile_values(scored, "score", [1.0 - share], rows)[0]
    return scored.withColumn("label", (F.col("score") > F.lit(edge)).cast("int"))


def knn_distance(df: DataFrame, params: dict | None = None) -> DataFrame:
    """Mean distance to the k nearest others."""
    params = params or {}
    points, scaler = _scaled(df, params)
    found = self_nearest(points, int_param(params, "k", 10))
    mean = F.aggregate("distances", F.lit(0.0), lambda a, d: a + d) / F.size("distances")
    scored = cut_lineage(found.select("i", mean.alias("score")))
    return _label_above(scored, _share(params) or DEFAULT_SHARE, scaler.rows)


def local_outlier_factor(df: DataFrame, params: dict | None = None) -> DataFrame:
    """Ratio of the neighbours' local density to the row's own.

    The k-distance of each neighbour is joined on its id; a row that is the
    neighbour of very many is split by Spark's skew handling on that join.
    """
    params = params or {}
    points, scaler = _scaled(df, params, 3)
    k = min(int_param(params, "k", 20, 2), scaler.rows - 1)
    # Read four times below; searched once.
    found = cut_lineage(self_nearest(points, k))
    reach_of = found.select(F.col("i").alias("j"), F.element_at("distances", -1).alias("k_distance"))
    edges = exploded(found).select("i", "j", "distance")
    reached = edges.join(reach_of, "j").groupBy("i").agg(F.avg(F.greatest("distance", "k_distance")).alias("reach"))
    density = reached.select("i", (1.0 / (F.col("reach") + 1e-10)).alias("density"))
    others = density.select(F.col("i").alias("j"), F.col("density").alias("other"))
    around = edges.select("i", "j").join(others, "j").groupBy("i").agg(F.avg("other").alias("around"))
    scored = around.join(density, "i").select("i", (F.col("around") / F.col("density")).alias("score"))
    share = _share(params)
    if share is None:
        return scored.withColumn("label", (F.col("score") > 1.5).cast("int"))
    return _label_above(cut_lineage(scored), share, scaler.rows)


def mahalanobis(df: DataFrame, params: dict | None = None) -> DataFrame:
    """Distance to the mean under the pseudo-inverse of the sample covariance."""
    params = params or {}
    points, scaler = _scaled(df, params)
    stats = second_moments(points)
    covariance = stats.covariance * stats.rows / (stats.rows - 1)
    inverse = np.linalg.pinv(covariance + np.eye(len(covariance)) * 1e-10)
    shared = df.sparkSession.sparkContext.broadcast((stats.mean, inverse))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, weight = shared.value
        for batch in table_batches(batches, 2 * CHUNK_ROWS):
            gap = matrix(batch.column("features")) - mean
            score = np.sqrt(np.maximum(((gap @ weight) * gap).sum(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(score)], names=["i", "score"])

    return _label_above(points.mapInArrow(run, "i bigint, score double"), _share(params) or DEFAULT_SHARE, scaler.rows)


# --- isolation forest --------------------------------------------------------

TREE_ROWS = 256


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=np.float64)
    harmonic = np.log(np.maximum(n - 1, 1.0)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple[int, float, int, int, float]]:
    """One random tree as rows (feature, cut, left, right, path length at a leaf)."""
    nodes: list = []

    def add(rows: np.ndarray, depth: int) -> int:
        here = len(nodes)
        nodes.append(None)
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or not len(open_features):
            nodes[here] = (-1, 0.0, -1, -1, depth + float(_average_path(len(rows))))
            return here
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        below = rows[:, f] <= cut
        if below.all():
            below = rows[:, f] < high[f]
        nodes[here] = (f, cut, add(rows[below], depth + 1), add(rows[~below], depth + 1), 0.0)
        return here

    add(points, 0)
    return nodes


def isolation_forest(df: DataFrame, params: dict | None = None) -> DataFrame:
    """Random trees on fixed-size draws, then one scoring pass.

    Each tree's draw is the rows with the smallest hash for that tree, so the
    same seed gives the same forest whatever the partitioning.  Draws have 256
    rows by definition, so trees grow in parallel groups of known size and the
    forest's node table is small.
    """
    params = params or {}
    points, scaler = _scaled(df, params)
    trees, seed = int_param(params, "n_estimators", 200, 10), seed_param(params)
    size = min(TREE_ROWS, scaler.rows)
    depth_limit = int(np.ceil(np.log2(max(size, 2))))
    spark = df.sparkSession
    # Rows likely to be drawn: a hash threshold keeps the expected number of
    # candidates per tree at a small multiple of the draw before the exact cut.
    odds = min(1.0, 4.0 * size / scaler.rows + 64.0 / scaler.rows)
    ticket = F.pmod(F.xxhash64("i", "tree", F.lit(seed)), F.lit(1 << 40))
    entries = (
        points.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("ticket", ticket)
        .where(F.col("ticket") < F.lit(int(odds * (1 << 40))))
    )
    chosen = entries.withColumn("n", F.row_number().over(Window.partitionBy("tree").orderBy("ticket", "i"))).where(F.col("n") <= size)

    def plant(key: tuple, rows: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        order = np.argsort(ints(rows.column("i").combine_chunks()))
        nodes = _grow(matrix(rows.column("features"))[order], np.random.default_rng([seed, tree]), depth_limit)
        columns = list(zip(*nodes))
        return pa.table({
            "tree": pa.array([tree] * len(nodes), pa.int32()), "node": pa.array(range(len(nodes)), pa.int32()),
            "feature": pa.array(columns[0], pa.int32()), "cut": pa.array(columns[1], pa.float64()),
            "left": pa.array(columns[2], pa.int32()), "right": pa.array(columns[3], pa.int32()),
            "path": pa.array(columns[4], pa.float64()),
        })

    forest = chosen.select("tree", "i", "features").groupBy("tree").applyInArrow(
        plant, "tree int, node int, feature int, cut double, left int, right int, path double")
    table = forest.toPandas().sort_values(["tree", "node"])
    packed = [tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "path")) for _t, g in table.groupby("tree")]
    shared = spark.sparkContext.broadcast(packed)
    scale = float(_average_path(size)) or 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_batches(batches, 4 * CHUNK_ROWS):
            rows = matrix(batch.column("features"))
            total = np.zeros(len(rows))
            for feature, cut, left, right, path in shared.value:
                node = np.zeros(len(rows), dtype=np.int64)
                while True:
                    moving = np.flatnonzero(feature[node] >= 0)
                    if not len(moving):
                        break
                    here = node[moving]
                    below = rows[moving, feature[here]] <= cut[here]
                    node[moving] = np.where(below, left[here], right[here])
                total += path[node]
            value = np.power(2.0, -(total / len(shared.value)) / scale)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(value)], names=["i", "score"])

    scored = points.mapInArrow(score, "i bigint, score double")
    share = _share(params)
    if share is None:
        return scored.withColumn("label", (F.col("score") > 0.5).cast("int"))
    return _label_above(cut_lineage(scored), share, scaler.rows)


ALGORITHMS = {
    "knn": knn_distance,
    "lof": local_outlier_factor,
    "mahalanobis": mahalanobis,
    "isolation_forest": isolation_forest,
}
