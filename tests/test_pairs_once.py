"""Pairs of a drift come once, and both spaces of an imbalance are searched once."""

import numpy as np
import pytest
from conftest import frame_of
from pyspark.sql import functions as F

from vectorloom.operators import crossset, neighbors
from vectorloom.session import BROADCAST_BYTES_KEY


def tagged(spark, values, ids=None):
    return frame_of(spark, values, ids).withColumn("tag", F.lit(0).cast("bigint"))


def test_each_pair_is_counted_once(spark):
    values = np.random.default_rng(0).normal(size=(90, 5))
    values[80:] = values[:10]
    found = crossset._median_slots(tagged(spark, values).repartition(3), 4.0, 9.0, 64)
    square = ((values[:, None] - values[None]) ** 2).sum(2)[np.triu_indices(90, 1)]
    assert found.pop(-2) == 10 and found.pop(-1) == (square < 4).sum()
    assert sum(found.values()) == ((square >= 4) & (square < 9)).sum()


@pytest.mark.parametrize("share", [0.2, 0.0])
@pytest.mark.parametrize("step", [None, 1.0])
def test_median_inside_and_outside_the_window(spark, monkeypatch, share, step):
    monkeypatch.setattr(crossset, "WINDOW_SHARE", share)
    monkeypatch.setattr(crossset, "WINDOW_ROWS", 12)
    values = np.random.default_rng(1).normal(size=(121, 4)) + 30
    values = np.round(values / step) * step if step else values
    d = neighbors.pair_distances(values, values, "euclidean")
    spark.conf.set(BROADCAST_BYTES_KEY, "3000")
    try:
        found = crossset._distance_median(tagged(spark, values).repartition(3))
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    assert found == pytest.approx(np.median(d[d > 1e-12]), rel=1e-12)


def test_rows_that_are_all_equal_have_no_median(spark):
    assert crossset._distance_median(tagged(spark, np.ones((9, 3)))) == 1.0


def test_drift_of_sets_that_share_ids(spark):
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(40, 3)), rng.normal(size=(30, 3)) + 0.5
    found = crossset.drift(frame_of(spark, left), frame_of(spark, right))
    a, b = (left - left.mean(0)) / left.std(0), (right - left.mean(0)) / left.std(0)
    both = np.vstack([a, b])
    d = neighbors.pair_distances(both, both, "euclidean")
    width = np.median(d[d > 1e-12])
    k = np.exp(-d * d / (2 * width * width))
    mmd = k[:40, :40].mean() + k[40:, 40:].mean() - 2 * k[:40, 40:].mean()
    assert (found["bandwidth"], found["mmd2"]) == (pytest.approx(width), pytest.approx(mmd))


def test_imbalance_searches_and_ranks_each_space_once(spark, monkeypatch):
    calls = []

    def counted(name):
        work = getattr(crossset, name)

        def run(*given, **named):
            calls.append(name)
            return work(*given, **named)

        monkeypatch.setattr(crossset, name, run)

    counted("self_nearest")
    counted("broadcast_reduce")
    rng = np.random.default_rng(3)
    left = rng.normal(size=(50, 4))
    found = crossset.information_imbalance(frame_of(spark, left), frame_of(spark, rng.normal(size=(50, 4))))
    assert sorted(calls) == ["broadcast_reduce"] * 2 + ["self_nearest"] * 2
    # What was found is read back rather than worked out again.
    assert all("MapInArrow" not in found[k]._jdf.queryExecution().executedPlan().toString() for k in ("forward", "back", "overlap"))


def test_rows_of_an_id_stand_anywhere():
    ids = np.array([5, 3, 5, 9, 3, 5])
    rows, places = neighbors.places_of(np.array([3, 7, 5]), ids)
    assert sorted(zip(rows.tolist(), places.tolist())) == [(0, 1), (0, 4), (2, 0), (2, 2), (2, 5)]
    assert (np.diff(places) > 0).all()


@pytest.mark.parametrize("k", [1, 7])
def test_nearest_over_many_tiles(monkeypatch, k):
    monkeypatch.setattr(neighbors, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbors, "TILE_COLUMNS", 24)
    rng = np.random.default_rng(4)
    r = rng.integers(0, 4, size=(400, 3)).astype(float)
    ids = rng.permutation(400)
    ids[10:20] = ids[:10]
    at, found, dist = neighbors.nearest_block(r[:70], ids[:70], r, ids, k, "euclidean", True)
    for row in range(70):
        d = np.sqrt(((r - r[row]) ** 2).sum(1))
        wanted = sorted((d[j], ids[j]) for j in range(400) if ids[j] != ids[row])[:k]
        assert list(zip(dist[at == row], found[at == row])) == wanted
