import dataclasses

import numpy as np
import pytest

from test_expansion import crystal
from vectorloom.errors import LoomError
from vectorloom.expansion import aftercare, search
from vectorloom.expansion.mutations import Rules
from vectorloom.functions.descriptors import radial_histogram


def test_key_follows_what_a_run_depends_on():
    settings, budget, rules = search.Settings(), search.Budget(), Rules()
    key = aftercare.run_key(settings, budget, rules, "f", "s")
    assert key == aftercare.run_key(search.Settings(), search.Budget(), Rules(), "f", "s")
    others = [
        aftercare.run_key(dataclasses.replace(settings, seed=1), budget, rules, "f", "s"), aftercare.run_key(settings, budget, rules, "g", "s"),
        aftercare.run_key(settings, dataclasses.replace(budget, max_accepted=3), rules, "f", "s"), aftercare.run_key(settings, budget, Rules(min_distance=0.9), "f", "s"),
        aftercare.run_key(settings, budget, rules, "f", "t"), aftercare.run_key(settings, budget, rules, "f", "s", screen="2"),
        aftercare.run_key(settings, budget, rules, "f", "s", target={"radius": 2.0})]
    assert len({key, *others}) == 8
    assert aftercare.run_key(dataclasses.replace(settings, seed=None), budget, rules, "f", "s") is None


def test_candidates_course_and_dataset_of_a_run(spark, tmp_path):
    frames = crystal(spark, 2)
    settings = search.Settings(children_per_seed=3, batch_accept=2)
    run = search.run(frames, frames, radial_histogram(4.0, 6), settings, search.Budget(max_generations=2), folder=str(tmp_path / "run"))
    rows = {r["index"]: r for r in aftercare.candidates(spark, run).collect()}
    assert sorted(rows) == list(range(sum(r.evaluations for r in run.rounds)))
    assert [rows[k]["i"] for k in sorted(rows)] == sorted(r["i"] for r in rows.values())
    assert {r["i"] for r in rows.values() if r["accepted"]} == {r["i"] for r in run.accepted.collect()}
    one = aftercare.candidate(spark, run, 3).collect()
    assert len(one) == 1 and one[0]["i"] == rows[3]["i"] and one[0]["positions"] == rows[3]["positions"]
    for bad in (-1, len(rows), True):
        with pytest.raises(LoomError):
            aftercare.candidate(spark, run, bad)
    told = aftercare.course(spark, run).orderBy("generation").collect()
    assert told[-1]["evaluations_so_far"] == len(rows) and told[-1]["accepted_so_far"] == run.accepted.count() and told[-1]["best_so_far"] == max(r.best_fitness for r in run.rounds)
    base = frames.withColumnRenamed("i", "frame_index")
    found = aftercare.add_to_dataset(spark, base, run.accepted, str(tmp_path / "grown")).orderBy("frame_index").collect()
    accepted = run.accepted.orderBy("i").collect()
    assert len(found) == 2 + len(accepted) and [r["frame_index"] for r in found] == list(range(len(found)))
    for got, want in zip(found[2:], accepted):
        assert got["numbers"] == want["numbers"] and np.allclose(got["positions"], want["positions"], atol=1e-6)
    with pytest.raises(Exception, match="(?i)exist"):
        aftercare.add_to_dataset(spark, base, run.accepted, str(tmp_path / "grown"))
    with pytest.raises(LoomError):
        aftercare.add_to_dataset(spark, base, run.accepted.drop("cell"), str(tmp_path / "other"))


def test_numbers_follow_the_last_frame(spark):
    base = crystal(spark, 3).selectExpr("i + 10 AS frame_index", "numbers", "positions", "cell", "pbc", "CAST(1.5 AS DOUBLE) AS energy")
    more = crystal(spark, 2).selectExpr("100 - i AS i", "numbers", "positions", "cell", "pbc", "'x' AS operator")
    got = aftercare.appended(base, more).orderBy("frame_index").collect()
    assert [r["frame_index"] for r in got] == [10, 11, 12, 13, 14] and [r["energy"] for r in got] == [1.5] * 3 + [None] * 2 and "operator" not in got[0]
    first = aftercare.appended(base.limit(0), more).collect()
    assert sorted(r["frame_index"] for r in first) == [0, 1]
    assert aftercare.appended(base, more.limit(0)).count() == 3
