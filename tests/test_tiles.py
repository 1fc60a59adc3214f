"""Distances in tiles, and ranks that a matrix product screens."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import crossset, neighbors


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_differences_stay_in_small_tiles(metric):
    rng = np.random.default_rng(0)
    q, r = rng.normal(size=(7, 64)), rng.normal(size=(20_000, 64))
    tracemalloc.start()
    try:
        found = neighbors.pair_distances(q, r, metric)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < found.nbytes + (4 << 20)
    gap = np.abs(q[:, None, :] - r[None, :, :])
    plain = {"euclidean": np.sqrt((gap * gap).sum(2)), "manhattan": gap.sum(2), "chebyshev": gap.max(2)}[metric]
    np.testing.assert_allclose(found, plain, rtol=1e-13)


def test_rows_ahead_of_the_mate():
    rng = np.random.default_rng(1)
    r = rng.integers(-3, 4, size=(300, 3)) + 1000.0  # many ties, far from the origin
    r_ids, mate = rng.permutation(300), rng.integers(0, 300, 40)
    q, to = r[:40], r[[int(np.flatnonzero(r_ids == m)[0]) for m in mate]]
    d, own = neighbors.pair_distances(q, r, "euclidean"), np.sqrt(((q - to) ** 2).sum(1))
    close = d == own[:, None]
    plain = np.where(close, r_ids[None, :] < mate[:, None], d < own[:, None])
    assert (crossset._ahead(q, to, mate, r_ids, r) == plain).all()


def test_median_and_kernel_of_drift(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), v.tolist()) for k, v in enumerate(np.vstack([rng.normal(size=(60, 4)), np.zeros((3, 4))]))]
    df = spark.createDataFrame(rows, "i bigint, features array<double>").withColumn("tag", F.lit(0).cast("bigint"))
    points = np.array([v for _i, v in rows])
    d = neighbors.pair_distances(points, points, "euclidean")
    assert crossset._distance_median(df) == pytest.approx(np.median(d[d > 1e-12]), rel=1e-12)
