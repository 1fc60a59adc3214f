"""Reductions over a reference that goes out in slices give what one broadcast gives."""

import numpy as np
import pytest

from conftest import frame_of
from vectorloom.expansion import scoring
from vectorloom.operators import clusters, crossset, neighbors
from vectorloom.plans import registry
from vectorloom.plans.suite import spaces
from vectorloom.session import BROADCAST_BYTES_KEY


@pytest.fixture(params=[4000])
def sliced(spark, request):
    """Runs a function under a bound that makes three slices of 120 rows of six numbers."""

    def run(work):
        whole = work()
        spark.conf.set(BROADCAST_BYTES_KEY, str(request.param))
        try:
            return whole, work()
        finally:
            spark.conf.unset(BROADCAST_BYTES_KEY)

    return run


def _sets(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=(120, 6)), 3)
    values[60:70] = values[:10]
    return frame_of(spark, values), frame_of(spark, values[::-1] * [1, 2, 1, 0.5, 1, 1] + 0.3)


def test_drift(spark, sliced):
    left, right = _sets(spark)
    keys = ("mmd2", "bandwidth", "centroid_distance", "covariance_shift", "mmd_reference_rows", "mmd_query_rows")
    one, many = sliced(lambda: [crossset.drift(left, right)[k] for k in keys])
    assert one == pytest.approx(many, rel=1e-9) and one[-2:] == [120, 120]


def test_rank_contributions(spark, sliced):
    left, right = _sets(spark)

    def work():
        return sorted(map(tuple, crossset.rank_contributions(left, right, "euclidean", 120).collect()))

    one, many = sliced(work)
    assert len(one) == 120 and one == many
    points = {r["i"]: np.asarray(r["features"]) for r in right.collect()}
    near = {r["i"]: r["indices"][0] for r in neighbors.self_nearest(left, 1).collect()}
    for i, share in one[:20]:
        order = sorted((k for k in points if k != i), key=lambda k: (np.linalg.norm(points[k] - points[i]), k))
        assert share == pytest.approx(order.index(near[i]) / 118, abs=1 / 118)


def test_pairwise_summary(spark, sliced):
    left, _ = _sets(spark)

    def work():
        found = neighbors.broadcast_reduce(
            left.selectExpr("*", "0L AS tag"), left, spaces._cosine_row, "i bigint, low double, total double, high double, n bigint",
            lambda parts: parts.groupBy("i").agg({"low": "min", "total": "sum", "high": "max", "n": "sum"}))
        return sorted(map(tuple, found.select(sorted(found.columns)).collect()))

    one, many = sliced(work)
    assert len(one) == len(many) == 120 and np.allclose(one, many)


def test_coverage_gain(spark, sliced):
    left, right = _sets(spark)
    archive = scoring.Archive.__new__(scoring.Archive)
    archive.reference, archive.accepted = left, left.where("i < 4")
    one, many = sliced(lambda: sorted(map(tuple, scoring.coverage_gain(archive, right).collect())))
    assert len(one) == 120 and np.allclose(one, many)


def test_density_clusters(spark, sliced):
    left, _ = _sets(spark)
    one, many = sliced(lambda: sorted(map(tuple, clusters.dbscan(left, {"eps": 1.2, "min_samples": 3}).collect())))
    assert one == many


def test_requests_by_category(spark):
    assert registry.canonical("cluster") == ("kmeans", {}) and registry.canonical("outlier", {"k": 3}) == ("lof", {"k": 3})
    assert registry.canonical("sampling", {"algorithm": "cluster"})[0] == "cluster_representative"
    left, _ = _sets(spark)
    assert registry.run("cluster", [left], {"n_clusters": 3}).tables["labels"].count() == 120
    with pytest.raises(Exception):
        registry.canonical("outlier", {"algorithm": "kmeans"})
