"""Groups that are many and small, one that is large, and rows whose group is null."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import ordering
from vectorloom.plans import catalog


@pytest.fixture
def rounds(spark, monkeypatch):
    """Three hundred groups of three rows, one of 400 and 90 rows without a group."""
    monkeypatch.setattr(ordering, "LARGE_GROUP", 50)
    monkeypatch.setattr(ordering, "shuffle_width", lambda df: 4)
    rng = np.random.default_rng(5)
    group = [*np.repeat(np.arange(300), 3).tolist(), *[1000] * 400, *[None] * 90]
    order = rng.permutation(len(group)).tolist()
    return [(g, o, float(v)) for g, o, v in zip(group, order, rng.integers(0, 60, len(group)))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g bigint, o bigint, x double")


def test_only_large_groups_are_cut(spark, rounds):
    found = ordering._sliced(frame(spark, rounds), ["g"], "o", 4).collect()
    assert len(found) == len(rounds)
    assert {r["_range"] for r in found if r["g"] is not None and r["g"] < 300} == {0}
    assert {r["_range"] for r in found if r["g"] == 1000} == {r["_range"] for r in found if r["g"] is None} == {0, 1, 2, 3}


def test_totals_and_highest_of_all_groups(spark, rounds):
    made = ordering.running_totals(frame(spark, rounds).withColumn("one", F.lit(1)), ["g"], "o", "one")
    before = {r["o"]: (r["before"], r["total"]) for r in made.collect()}
    high = {r["o"]: r["highest"] for r in ordering.running_max(frame(spark, rounds), "o", "x", ("g",)).collect()}
    assert len(before) == len(high) == len(rounds)
    for g, o, _x in rounds:
        mine = [(b, x) for a, b, x in rounds if a == g]
        assert before[o] == (sum(b < o for b, _ in mine), len(mine))
        assert high[o] == max([x for b, x in mine if b < o], default=None)


def test_stagnation_of_all_groups(spark, rounds):
    found = {r["o"]: r["stagnant"] for r in catalog.stagnation(frame(spark, rounds), "g", "o", "x").collect()}
    assert len(found) == len(rounds)
    for group in {g for g, _o, _x in rounds}:
        best, since = None, 0
        for o, x in sorted((o, x) for g, o, x in rounds if g == group):
            since = 0 if best is None or x > best + 1e-9 else since + 1
            best = x if best is None else max(best, x)
            assert found[o] == since
