"""Mutual information against plain counts and closed forms."""

import numpy as np
import pytest

from vectorloom.operators import information
from vectorloom.session import BROADCAST_BYTES_KEY

from conftest import frame_of


def rows_of(spark, x, y):
    from pyspark.sql import functions as F

    df = frame_of(spark, np.column_stack([x, y]))
    return df.select("i", F.slice("features", 1, x.shape[1]).alias("features"), F.element_at("features", -1).alias("y"))


def harmonic_digamma(m):
    return -0.5772156649015329 + sum(1 / j for j in range(1, m))


def plain(x, y, k=3):
    x, y = x / x.std(), y / y.std()
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    r = np.sort(both, axis=1)[:, k - 1]
    nx, ny = ((np.where(r > 0, (d < r[:, None]).sum(1), (d == 0).sum(1))) for d in (dx, dy))
    total = sum(harmonic_digamma(a) + harmonic_digamma(b) for a, b in zip(nx.tolist(), ny.tolist()))
    return max(0.0, harmonic_digamma(len(x)) + harmonic_digamma(k) - total / len(x))


def sample(n=160):
    rng = np.random.default_rng(2)
    y = rng.normal(size=n)
    return np.column_stack([
        y + 0.3 * rng.normal(size=n), rng.normal(size=n), y**2, np.round(y), np.full(n, 3.0), rng.integers(0, 2, n), np.where(rng.random(n) < 0.9, 0.0, y),
    ]), y


def test_digamma():
    m = np.arange(1, 400)
    np.testing.assert_allclose(information.digamma(m.astype(float)), [harmonic_digamma(k) for k in m.tolist()], rtol=1e-10, atol=1e-11)


@pytest.mark.parametrize("form", ["sweep", "groups", "search"])
def test_both_forms_count_like_a_plain_loop(spark, form):
    x, y = sample()
    if form != "sweep":
        # Two columns fit, but not all; or no two do.
        spark.conf.set(BROADCAST_BYTES_KEY, str(8 * 160 * 3 if form == "groups" else 2000))
        x = x[:, [0, 3, 6]] if form == "search" else x
    try:
        found = dict(information.mutual_information(rows_of(spark, x, y)).collect())
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    want = {f: plain(x[:, f], y) for f in range(x.shape[1]) if x[:, f].std() > 0}
    assert found.keys() == want.keys()
    for f, value in want.items():
        assert abs(found[f] - value) < 1e-9, f


def test_stretches_and_windows(monkeypatch):
    monkeypatch.setattr(information, "STRETCH_ROWS", 37)
    x, y = sample(300)
    for f in (0, 3, 5, 6):
        a, b = x[:, f] / x[:, f].std(), y / y.std()
        sweep = information.Sweep(a, b)
        parts = [sweep.sums(start, 3) for start in range(0, 300, 37)]
        assert sum(n for _, n in parts) == 300
        value = harmonic_digamma(300) + harmonic_digamma(3) - sum(t for t, _ in parts) / 300
        assert abs(max(0.0, value) - plain(x[:, f], y)) < 1e-9


@pytest.mark.parametrize("r", [0.0, 0.6, 0.9])
def test_gaussian_pairs_are_near_the_closed_form(spark, r):
    rng = np.random.default_rng(7)
    y = rng.normal(size=6000)
    x = r * y + np.sqrt(1 - r * r) * rng.normal(size=6000)
    found = information.mutual_information(rows_of(spark, x[:, None], y)).first()[1]
    assert abs(found + 0.5 * np.log(1 - r * r)) < 0.05
