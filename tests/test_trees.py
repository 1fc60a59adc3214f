"""Tree clusterings without a limit of rows, in slices; searches that stay within small tiles."""

import tracemalloc

import numpy as np
import pytest

from conftest import frame_of
from vectorloom.operators import clusters, neighbors, spectrum
from vectorloom.session import BROADCAST_BYTES_KEY


def plain_tree(x, core):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    root, kept = np.arange(len(x)), []
    for w, a, b in sorted((d[a, b], a, b) for a in range(len(x)) for b in range(a + 1, len(x))):
        if root[a] != root[b]:
            root[root == root[b]] = root[a]
            kept.append((w, a, b))
    return np.array(kept)


@pytest.mark.parametrize("bound", [None, 2048])
def test_spanning_tree_in_slices(spark, bound):
    x = np.random.default_rng(0).integers(0, 5, size=(90, 3)).astype(float)  # with ties and copies
    core = np.random.default_rng(1).integers(0, 2, size=90).astype(float)
    if bound:
        spark.conf.set(BROADCAST_BYTES_KEY, str(bound))
    try:
        for reach in (np.zeros(90), core):
            np.testing.assert_allclose(clusters.spanning_tree(spark, x, reach), plain_tree(x, reach))
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)


@pytest.mark.parametrize("name", ["single", "ward", "hdbscan"])
def test_sets_beyond_the_broadcast_bound_are_clustered(spark, name):
    x = np.random.default_rng(2).normal(size=(90, 3)) * 0.4 + np.repeat([[0, 0, 0], [9, 0, 0], [0, 9, 0]], 30, axis=0)
    run = {"single": lambda d: clusters.single_linkage(d, {"n_clusters": 3}), "ward": lambda d: clusters.ward(d, {"n_clusters": 3}, local_rows=8),
           "hdbscan": lambda d: clusters.hdbscan(d, {"min_cluster_size": 8})}[name]
    whole = sorted(map(tuple, run(frame_of(spark, x)).collect()))
    spark.conf.set(BROADCAST_BYTES_KEY, "2048")
    try:
        assert sorted(map(tuple, run(frame_of(spark, x)).collect())) == whole
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    assert not hasattr(clusters, "ROW_LIMITS")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_few_coordinates_are_scanned_by_leaves(spark, metric, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(1500, 3)), np.zeros((300, 3)), rng.integers(0, 3, size=(300, 3))])
    df = frame_of(spark, x)
    met = neighbors._Leaves(x)
    assert (np.diff(met.starts) <= neighbors.LEAF_ROWS).all() and sorted(met.order) == list(range(len(x)))
    # A leaf of the dense part reaches few of the others.
    assert (met.gaps(x[met.order[: met.starts[1]]], metric) > 0.5).any(axis=1).all()
    plain = {r["i"]: (r["indices"], r["distances"]) for r in neighbors._scan_small(df, df, 5, metric, True).collect()}
    monkeypatch.setattr(neighbors, "_scan_small", None)
    assert {r["i"]: (r["indices"], r["distances"]) for r in neighbors.self_nearest(df, 5, metric).collect()} == plain


def test_scores_exist_for_a_tile_at_a_time():
    rng = np.random.default_rng(4)
    q, r = rng.normal(size=(2048, 8)), rng.normal(size=(16_384, 8))
    tracemalloc.start()
    try:
        neighbors.nearest_block(q, np.arange(2048), r, np.arange(16_384), 5, "euclidean", True)
        neighbors.radius_counts(q, r, np.ones(16_384, np.int64), 0.5, "euclidean")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20  # the scores of all pairs are 256 MB


def test_two_neighbours_are_searched_once(spark, monkeypatch):
    calls = []

    def counted(*given):
        calls.append(1)
        return neighbors.self_nearest(*given)

    monkeypatch.setattr(spectrum, "self_nearest", counted)
    found = spectrum.neighbor_ratios(frame_of(spark, np.random.default_rng(5).normal(size=(40, 3))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(calls) == 1 and "MapInArrow" not in plan
