"""Kernel rows and the Mantel test take every row where no subset is asked for."""

import numpy as np
import pytest
from conftest import frame_of

from vectorloom.operators import crossset, spectrum
from vectorloom.plans.suite import spaces
from vectorloom.session import BROADCAST_BYTES_KEY


@pytest.fixture
def narrow(spark):
    spark.conf.set(BROADCAST_BYTES_KEY, str(8 << 10))
    yield
    spark.conf.unset(BROADCAST_BYTES_KEY)


def test_kernel_of_all_rows(spark, narrow):
    values = np.random.default_rng(1).normal(size=(700, 4))
    rows = {r["i"]: np.array(r["kernel"]) for r in spectrum.kernel_rows(frame_of(spark, values)).collect()}
    z = (values - values.mean(0)) / values.std(0)
    square = ((z[:, None] - z[None]) ** 2).sum(2)
    assert sorted(rows) == list(range(700))
    np.testing.assert_allclose(np.array([rows[i] for i in range(700)]), np.exp(-square / 4), atol=1e-12)


def test_kernel_of_an_asked_subset(spark):
    values = np.random.default_rng(1).normal(size=(60, 4))
    rows = spectrum.kernel_rows(frame_of(spark, values), {"max_samples": 20}).collect()
    assert len(rows) == 20 and {len(r["kernel"]) for r in rows} == {20}


def brute(left, right, permutations, seed=42):
    n = len(left)
    a, b = (np.sqrt(((s[:, None] - s[None]) ** 2).sum(2)) for s in (left, right))
    upper = np.triu_indices(n, 1)
    out = [np.corrcoef(a[upper], b[upper])[0, 1]]
    for p in range(permutations):
        order = np.random.default_rng([seed, p]).permutation(n)
        out.append(np.corrcoef(a[upper], b[np.ix_(order, order)][upper])[0, 1])
    return out


@pytest.mark.parametrize("rows", [3, 17, 700])
def test_mantel_of_all_rows(spark, narrow, rows, monkeypatch):
    monkeypatch.setattr(crossset, "PAIR_ROWS", 100)
    rng = np.random.default_rng(rows)
    left = rng.normal(size=(rows, 5))
    right = left + 3 * rng.normal(size=(rows, 5))
    left[rows // 2], right[rows // 2] = left[0], right[0]
    found = crossset.mantel(frame_of(spark, left), frame_of(spark, right), {"permutations": 7, "seed": 42})
    wanted = brute((left - left.mean(0)) / left.std(0), (right - right.mean(0)) / right.std(0), 7)
    assert found["pair_count"] == rows * (rows - 1) // 2 and found["sample_count"] == rows
    assert found["statistic"] == pytest.approx(wanted[0], abs=1e-9)
    assert [r["r"] for r in found["null"].orderBy("id").collect()] == pytest.approx(wanted[1:], abs=1e-9)


def test_mantel_of_equal_and_constant_spaces(spark):
    values = np.random.default_rng(2).normal(size=(30, 3)) + 1e6
    assert crossset.mantel(*[frame_of(spark, values)] * 2, {"permutations": 3})["statistic"] == pytest.approx(1.0)
    corners = np.eye(5)
    raw = {"permutations": 3, "preprocess": "raw"}
    assert crossset.mantel(*[frame_of(spark, corners)] * 2, raw)["statistic"] == 1.0
    assert crossset.mantel(frame_of(spark, corners), frame_of(spark, 2 * corners), raw)["statistic"] == 0.0


@pytest.mark.parametrize("query", [spaces.kernel, spaces.mantel])
def test_queries_ask_for_no_subset(monkeypatch, query):
    asked = []

    def stop(*given):
        asked.append(next((g for g in given if isinstance(g, dict)), {}))
        raise StopIteration

    monkeypatch.setattr(spectrum, "kernel_rows", stop)
    monkeypatch.setattr(crossset, "mantel", stop)
    monkeypatch.setattr(spaces, "embeddings", lambda spark, sf: None)
    monkeypatch.setattr(spaces, "_halves", lambda spark, sf: (None, None))
    with pytest.raises(StopIteration):
        query(None, None)
    assert asked[0].get("max_samples") is None
