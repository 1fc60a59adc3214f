"""Weighted neighbour graph of a vector set.

Each row turns its neighbour distances into membership weights with a width of
its own; the two directions of an edge are then joined into one weight.  Rows
carry at most k neighbours, so nothing grows with the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import ints, table_batches
from ..params import choice, int_param
from . import preprocess
from .neighbors import METRICS, self_nearest

# Bisection steps and the relative floor of a row's width.
BISECTIONS = 64
WIDTH_FLOOR = 1e-3


def row_widths(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset and width per row so that the memberships of its neighbours sum to log2(k).

    ``distances`` are those of the k - 1 nearest others, as k counts the row
    itself.  The nearest one is the offset.
    """
    k = distances.shape[1] + 1
    offset = distances.min(axis=1)
    gap = np.maximum(distances - offset[:, None], 0.0)
    low, high, width = np.zeros(len(gap)), np.full(len(gap), np.inf), np.ones(len(gap))
    for _step in range(BISECTIONS):
        total = np.exp(-gap / width[:, None]).sum(axis=1)
        above = total > np.log2(k)
        high, low = np.where(above, width, high), np.where(above, low, width)
        width = np.where(np.isfinite(high), (low + high) / 2, width * 2)
    return offset, np.maximum(width, WIDTH_FLOOR * distances.mean(axis=1))


def fuzzy_graph(df: DataFrame, params: dict | None = None) -> DataFrame:
    """``a, b, weight`` with a below b: probabilistic union of both directions."""
    params = params or {}
    scaler = preprocess.fit(df, choice(params, "preprocess", "raw", preprocess.MODES))
    k = min(int_param(params, "n_neighbors", 15, 2), scaler.rows) - 1
    found = self_nearest(scaler.apply(df), max(k, 1), choice(params, "metric", "euclidean", METRICS))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_batches(batches, 2048):
            near = np.asarray(batch.column("distances").flatten(), dtype=float).reshape(batch.num_rows, -1)
            mates = np.asarray(batch.column("indices").flatten()).reshape(near.shape)
            offset, width = row_widths(near)
            weight = np.exp(-np.maximum(near - offset[:, None], 0.0) / np.maximum(width, 1e-300)[:, None])
            own = np.repeat(ints(batch.column("i")), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(mates.reshape(-1)), pa.array(weight.reshape(-1))], names=["i", "j", "w"])

    edges = found.mapInArrow(weigh, "i bigint, j bigint, w double")
    both = edges.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.sum("w").alias("s"), F.min("w").alias("low"), F.max("w").alias("high"), F.count(F.lit(1)).alias("n"))
    return both.select("a", "b", F.when(F.col("n") == 2, F.col("s") - F.col("low") * F.col("high")).otherwise(F.col("s")).alias("weight"))
