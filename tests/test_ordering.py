import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import session
from vectorloom.operators import ordering
from vectorloom.plans import catalog


@pytest.fixture(params=["one range", "many ranges"])
def ranges(request, monkeypatch):
    monkeypatch.setattr(session, "SMALL_BYTES", session.SMALL_BYTES if request.param == "one range" else -1)
    return request.param


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(0)
    # One group has most rows and one value most of them.
    data = [(k, "hot" if k % 10 else f"g{k % 3}", float(7.0 if k % 3 else rng.integers(0, 40)) + 0.5) for k in range(600)]
    return spark.createDataFrame(data, "i bigint, g string, x double"), data


def test_quantiles_and_ranks(rows, ranges):
    df, data = rows
    x = np.array([r[2] for r in data])
    got = ordering.quantile_values(df, "x", [0, 0.05, 0.5, 0.95, 1])
    np.testing.assert_allclose(got, np.quantile(x, [0, 0.05, 0.5, 0.95, 1]))
    by = {r["g"]: r["m"] for r in ordering.exact_quantiles(df, ["g"], "x", [0.3], ["m"]).collect()}
    for g in by:
        assert by[g] == pytest.approx(np.quantile([r[2] for r in data if r[1] == g], 0.3))
    ranks = {r["i"]: r["rank"] for r in ordering.average_ranks(df, [], "x").collect()}
    want = [(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]
    np.testing.assert_allclose([ranks[k] for k in range(len(x))], want)
    place = {r["i"]: r["pos"] for r in ordering.positions(df.select((df.i * 3).alias("i")), "i").collect()}
    assert all(place[3 * k] == k for k in range(len(x)))


def test_lags_windows_and_maxima(rows, ranges):
    df, data = rows
    lag = {r["i"]: r["prev_x"] for r in ordering.previous_rows(df, "i", ["x"], ("g",)).collect()}
    recent = {r["i"]: r["recent"] for r in ordering.recent_values(df, "i", "x", 4, ("g",)).collect()}
    high = {r["i"]: r["highest"] for r in ordering.running_max(df, "i", "x", ("g",)).collect()}
    total = {r["i"]: r["trailing"] for r in catalog.trailing_sum(df, "g", "i", "x", 3).collect()}
    still = {r["i"]: r["stagnant"] for r in catalog.stagnation(df, "g", "i", "x").collect()}
    past: dict = {}
    since: dict = {}
    for i, g, x in data:
        before = past.setdefault(g, [])
        assert lag[i] == (before[-1] if before else None)
        assert recent[i] == before[-4:]
        assert high[i] == (max(before) if before else None)
        assert total[i] == pytest.approx(sum(before[-2:]) + x)
        since[g] = 0 if not before or x > max(before) + 1e-9 else since[g] + 1
        assert still[i] == since[g]
        before.append(x)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 2, 39.999, 40]], "x double")
    counts = [r["n"] for r in ordering.histogram(df, [], "x", 40).orderBy("bin").collect()]
    assert counts == np.histogram([0, 1, 1, 2, 39.999, 40], bins=40)[0].tolist()
    flat = ordering.histogram(spark.createDataFrame([(3.0,)] * 5, "x double"), [], "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in flat] == np.histogram([3.0] * 5, bins=4)[0].tolist() and flat[0]["lo"] == 2.5


def test_rows_of_a_heavy_value_stay_spread(spark, monkeypatch):
    """With nine rows in ten of one value no task has more than twice the median's rows."""
    monkeypatch.setattr(session, "SMALL_BYTES", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        x = [5.0 if k % 10 else float(k) for k in range(8000)] + [float("nan")] * 40
        df = spark.createDataFrame([(k, v) for k, v in enumerate(x)] + [(-1, None)], "i bigint, x double").repartition(8)
        ranked = ordering.average_ranks(df, [], "x")
        rows = ranked.select("i", "x", "rank", F.spark_partition_id().alias("p")).collect()
        sizes = sorted(np.bincount([r["p"] for r in rows if r["x"] == 5.0]).tolist())
        assert sum(sizes) == 7200 and sizes[-1] <= 2 * np.median([n for n in sizes if n])
        v = np.array(x[:8000])
        got = {r["i"]: r["rank"] for r in rows}
        assert len(got) == 8040 and all(got[k] == (v < v[k]).sum() + ((v == v[k]).sum() + 1) / 2 for k in range(0, 8000, 37))
        assert {got[k] for k in range(8000, 8040)} == {8000 + 41 / 2}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
