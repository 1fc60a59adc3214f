import numpy as np
import pytest

from conftest import frame_of
from vectorloom.errors import LoomError
from vectorloom.expansion import mutations as mu
from vectorloom.expansion import scoring, search
from vectorloom.functions.descriptors import radial_histogram
from vectorloom.session import BROADCAST_BYTES_KEY

ATOMS = "i bigint, numbers array<int>, positions array<array<double>>, cell array<array<double>>, pbc array<boolean>"


def crystal(spark, n=4):
    rng = np.random.default_rng(0)
    base = np.array([[0, 0, 0], [2.7, 2.7, 0], [2.7, 0, 2.7], [0, 2.7, 2.7]], dtype=float)
    rows = [(k, [14, 14, 14, 32], (base + rng.normal(scale=0.02, size=base.shape)).tolist(), (np.eye(3) * 5.4).tolist(), [True] * 3) for k in range(n)]
    return spark.createDataFrame(rows, ATOMS)


def test_every_change_keeps_its_promise():
    rng = np.random.default_rng(1)
    a = mu.Atoms(np.array([14, 14, 8]), np.arange(9.0).reshape(3, 3) * 1.3, np.eye(3) * 12, np.array([True] * 3))
    assert len(mu.remove_atom(a, rng, {}).numbers) == 2 and len(mu.add_atom(a, rng, {"element": "C"}).numbers) == 4
    assert sorted(mu.swap_unlike(a, rng, {}).numbers) == [8, 14, 14]
    assert (mu.substitute(a, rng, {}).numbers != a.numbers).sum() == 1
    assert mu.swap_unlike(mu.Atoms(np.array([6]), np.zeros((1, 3)), np.eye(3), a.pbc), rng, {}) is None
    assert np.linalg.norm(mu.displace(a, rng, {"hard_cutoff": 0.01}).xyz - a.xyz, axis=1).max() <= 0.01 + 1e-12
    even = mu.strain_evenly(a, rng, {"max_strain": 0.1})
    assert np.linalg.det(even.box) / np.linalg.det(a.box) - 1 == pytest.approx(even.note["volume_change"])
    rules = mu.Rules()
    close = mu.Atoms(a.numbers, a.xyz * 0.01, a.box, a.pbc)
    assert rules.reason(a, a) is None and "contact" in rules.reason(close, a)
    assert "volume" in mu.Rules(max_volume_per_atom=1.0).reason(a, a)


def test_objective_schema():
    assert scoring.check_objective({"type": "composite"})["local_weight"] == 0.7
    with pytest.raises(LoomError):
        scoring.check_objective({"type": "novelty", "top_fraction": 0.1})


def test_coverage_gain_matches_definition(spark):
    x = np.random.default_rng(3).normal(size=(40, 2))
    c = np.random.default_rng(4).normal(size=(5, 2))
    archive = scoring.Archive.of(frame_of(spark, x), "raw")
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    got = dict(scoring.coverage_gain(archive, frame_of(spark, c)).collect())
    np.testing.assert_allclose([got[k] for k in range(5)], -d.max(0))
    spark.conf.set(BROADCAST_BYTES_KEY, "64")
    try:
        sliced = dict(scoring.coverage_gain(archive, frame_of(spark, c)).collect())
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    assert sliced == got
    later = archive.with_accepted(frame_of(spark, c[:1]))
    got = dict(scoring.coverage_gain(later, frame_of(spark, c)).collect())
    now = d[:, 0]
    np.testing.assert_allclose([got[k] for k in range(5)], np.maximum(now.max() - np.minimum(now[:, None], d).max(0), 0), atol=1e-12)


def test_unique_count_ignores_arrival(spark):
    x = np.zeros((1, 2))
    archive = scoring.Archive.of(frame_of(spark, np.array([[0.0, 0], [1, 1]])), "raw")
    rows = spark.createDataFrame([(5, 0, [9.0, 0.0]), (5, 1, [9.1, 0.0]), (7, 0, [9.05, 0.0]), (7, 1, [20.0, 0.0]), (8, 0, [0.1, 0.0])],
                                 "i bigint, row int, features array<double>")
    assert scoring.unique_environments(rows, archive, 0.5, [7, 5, 8]) == 2
    assert scoring.unique_environments(rows, archive, 0.5, [5, 7, 8], canonical=False) == 2
    assert x.shape == (1, 2)


@pytest.mark.parametrize("optimizer,objective", [("random", "novelty"), ("genetic", "local_environment_novelty"), ("pso", "coverage")])
def test_runs_end_and_resume(spark, tmp_path, optimizer, objective):
    frames = crystal(spark)
    settings = search.Settings(optimizer=optimizer, objective={"type": objective}, operators={"atomic_displacement": {}, "anisotropic_strain": {}},
                               children_per_seed=4, batch_accept=3, reuse_accepted_seeds=True)
    budget = search.Budget(max_generations=2, max_evaluations=500)
    run = search.run(frames, frames, radial_histogram(4.0, 6), settings, budget, folder=str(tmp_path / "run"))
    assert run.stopped_by == "max_generations" and len(run.rounds) == 2
    assert all(r.accepted == 3 and r.evaluations + r.invalid == r.proposed for r in run.rounds)
    rows = run.accepted.collect()
    assert len({r["i"] for r in rows}) == 6 and all(sorted(r["numbers"]) == [14, 14, 14, 32] for r in rows)
    again = search.run(frames, frames, radial_histogram(4.0, 6), settings, budget, folder=str(tmp_path / "run"), resume=True)
    assert [r.best_fitness for r in again.rounds] == [r.best_fitness for r in run.rounds]


def test_swarm_remembers_its_best_and_goes_where_most_pulls(spark):
    from pyspark.sql import functions as F

    from vectorloom.expansion import swarm

    state = swarm.newborn(spark, 3)
    first = spark.createDataFrame([(0, 10, 1.0, [0.0, 0.0]), (0, 11, 5.0, [1.0, 0.0]), (1, 12, 3.0, [4.0, 0.0]), (1, 13, float("-inf"), [9.0, 9.0]), (2, 14, None, [1.0, 1.0])],
                                  "slot bigint, i bigint, fitness double, at array<double>")
    state = swarm.advanced(state, first)
    mean, std = 3.0, float(np.std([1.0, 5.0, 3.0]))
    told = {r["slot"]: r for r in state.collect()}
    assert (told[0]["position"], told[0]["best"], told[1]["best"], told[2]["best"]) == (11, 11, 12, None)
    assert abs(told[0]["best_z"] - (5 - mean) / std) < 1e-12 and told[2]["position"] is None
    # A worse standing moves the particle, but is not remembered.
    second = spark.createDataFrame([(0, 20, 1.0, [3.0, 0.0]), (1, 21, 2.0, [4.0, 3.0])], "slot bigint, i bigint, fitness double, at array<double>")
    state = swarm.advanced(state, second)
    told = {r["slot"]: r for r in state.collect()}
    assert (told[0]["position"], told[0]["best"], told[1]["position"], told[1]["best"]) == (20, 11, 21, 21)
    names = list(swarm.DRAWS)

    def goal(slot, anchor=None, **draws):
        row = spark.createDataFrame([(slot, 0, *[float(draws.get(n, 0.5)) for n in names])], "slot bigint, child bigint, " + ", ".join(f"{n} double" for n in names))
        return swarm.targets(state, row, swarm.Pulls(), 0.15, anchor).first()["parent"]

    anchor = spark.createDataFrame([(99, [3.0, 40.0])], "anchor bigint, anchor_at array<double>")
    assert goal(0, u_reset=0.1) is None and goal(2) is None
    assert goal(0) == 11 and goal(1, u_leader=0.0, u_change=0.9) == 21 and goal(1, u_leader=0.9) == 11
    assert goal(0, u_best=0.0, u_leader=0.0) == 20 and goal(0, anchor) == 99 and goal(0, anchor, u_anchor=0.0) == 11
    spread = swarm.drawn(swarm.newborn(spark, 50), 40, 1, 2).select(*[F.avg(n).alias(n) for n in names], F.min("u_best").alias("least"), F.max("u_best").alias("most")).first()
    assert all(abs(spread[n] - 0.5) < 0.03 for n in names) and spread["least"] >= 0 and spread["most"] < 1
