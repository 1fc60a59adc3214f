import numpy as np
import pytest

from conftest import frame_of
from test_expansion import crystal
from vectorloom.errors import LoomError
from vectorloom.expansion import breeding, mutations, search
from vectorloom.functions.descriptors import radial_histogram

OPERATORS = {"atomic_displacement": {"max_sigma": 0.3}, "cell_shear": {}, "vacancy": {}}


def pool_of(spark, n, width=2):
    x = np.random.default_rng(n).normal(size=(n, width))
    rows = [(k, 100 + k, x[k].tolist(), [0.1 + k / 100, 0.05, 0.2], [1.0, 0.5, 0.06]) for k in range(n)]
    return spark.createDataFrame(rows, breeding.STATE), x


def test_immigrants_and_rank_weights():
    assert breeding.immigrant_slots(20, 0, 0.15, 0) == 20 and breeding.immigrant_slots(20, 5, 0.15, 0) == 3
    # A cold pool raises the share, never lowers it.
    assert breeding.immigrant_slots(20, 4, 0.15, 16) == 6 and breeding.immigrant_slots(20, 4, 0.5, 16) == 10 and breeding.immigrant_slots(20, 16, 0.15, 16) == 3
    assert breeding.rank_weights(4, breeding.Breeding(parent_fraction=1.0)).tolist() == [16, 9, 4, 1]
    assert breeding.rank_weights(10, breeding.Breeding()).tolist() == [49, 36, 25, 16, 9, 4, 1]
    assert breeding.rank_weights(3, breeding.Breeding(warm_pool=8)).tolist() == [1, 1, 1] and not len(breeding.rank_weights(0, breeding.Breeding()))
    for bad in ({"parent_fraction": 0.0}, {"gene_rate": 0.0}, {"warm_pool": -1}):
        with pytest.raises(LoomError):
            breeding.Breeding(**bad)


def test_success_moves_factors(spark):
    rows = spark.createDataFrame([("a", 100, 30), ("b", 100, 0), ("c", 0, 0), ("d", 10, 0)], "operator string, proposed bigint, accepted bigint")
    got = dict(breeding.success_factors(rows).collect())
    assert got == pytest.approx({"a": 1.9, "b": 0.55, "c": 1.0, "d": 0.55})
    assert set(dict(breeding.success_factors(rows.where("operator <> 'a'")).collect()).values()) == {1.0}


def test_pool_keeps_the_farthest_in_the_order_of_picks(spark):
    pool, x = pool_of(spark, 12)
    more = np.vstack([np.random.default_rng(99).normal(size=(5, 2)), x[:1]])
    arrived = spark.createDataFrame([(k, 500 + k, more[k].tolist(), [1.0, 0.1, 0.1], [1.0] * 3) for k in range(6)] + [(6, 900, None, None, None)],
                                    "place bigint, i bigint, at array<double>, genes array<double>, shares array<double>")
    grown = breeding.renewed(pool, arrived, 50).orderBy("rank").collect()
    assert [r["i"] for r in grown] == [*range(100, 112), *range(500, 506)]
    points = np.vstack([x, more])
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    picks, gap = [start], np.linalg.norm(points - points[start], axis=1)
    while len(picks) < 9:
        gap[picks] = -1
        picks.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[picks[-1]], axis=1))
    kept = breeding.renewed(pool, arrived, 9).orderBy("rank").collect()
    assert [r["rank"] for r in kept] == list(range(9)) and [r["i"] for r in kept] == [grown[p]["i"] for p in picks]
    assert all(r["genes"] == grown[p]["genes"] for r, p in zip(kept, picks))
    assert breeding.renewed(breeding.newborn(spark), arrived.limit(0), 9).count() == 0


def test_children_follow_their_draws(spark):
    how = breeding.Breeding(parent_fraction=1.0)
    pool, _x = pool_of(spark, 3)
    seeds = spark.createDataFrame([(0, 7), (1, 8)], "place bigint, seed bigint")
    zero = [0.0] * 6
    rows = [(1000, 0, 0.6, [5.0] * 6, [0.9, 0.5, 0.5]),  # An immigrant keeps the founder's genome.
            (1001, 1, 0.0, zero, [0.5, 0.9, 0.9]), (1002, 1, 9 / 14, zero, [0.5, 0.5, 0.5]), (1003, 1, 0.999, [1.0, -1.0, 100.0, 5.0, -5.0, 0.0], [0.1, 0.1, 0.99])]
    draws = spark.createDataFrame(rows, "i bigint, slot bigint, u_parent double, normals array<double>, u_order array<double>")
    weights = breeding.rank_weights(3, how).tolist()
    got = {r["i"]: r for r in breeding.children(draws, pool, seeds, OPERATORS, weights, [1.0, 1.0], 1, how).collect()}
    assert [got[k]["parent"] for k in (1000, 1001, 1002, 1003)] == [8, 100, 101, 102]
    assert got[1000]["genes"] == [0.3, 0.05, 0.05] and got[1000]["shares"] == [1.0] * 3 and got[1000]["operator"] == "atomic_displacement"
    assert got[1001]["genes"] == [0.1, 0.05, 0.2]
    # Genes and shares stay in their ranges.
    assert got[1003]["genes"] == pytest.approx([0.12 * 1.3, 0.05 * 0.7, 0.5]) and got[1003]["shares"] == pytest.approx([1.0, 0.05, 0.06])
    wait = -np.log([0.1, 0.1, 0.99]) / np.array([1.0, 0.05, 0.06])
    assert got[1003]["tries"] == [list(OPERATORS)[k] for k in np.argsort(wait)]
    # Ranks that may not be drawn are never parents; seeds beside the parents can be.
    few = breeding.children(draws, pool, seeds, OPERATORS, [1.0], [1.0, 1.0], 0, how, {"cell_shear": 2.0}, beside=[0.0, 1.0]).collect()
    assert {r["i"]: r["parent"] for r in few} == {1000: 8, 1001: 100, 1002: 8, 1003: 8}
    first = breeding.children(draws, breeding.newborn(spark), seeds, OPERATORS, [], [1.0, 0.0], 2, how).collect()
    assert {r["parent"] for r in first} == {7}


def test_draws_are_spread_and_repeat(spark):
    rows = breeding.drawn(spark, 500, 8, 10, 2, 3, 4).collect()
    again = breeding.drawn(spark, 500, 8, 10, 2, 3, 4).repartition(3).collect()
    assert sorted(rows) == sorted(again) and [r["i"] for r in sorted(rows)] == list(range(10, 4010))
    normals = np.array([r["normals"] for r in rows])
    assert normals.shape == (4000, 5) and abs(normals.mean()) < 0.03 and abs(normals.std() - 1) < 0.03 and abs(np.corrcoef(normals.T)[0, 1:]).max() < 0.06
    assert 0 < min(r["u_parent"] for r in rows) and max(r["u_parent"] for r in rows) < 1


def test_genes_stand_in_for_amplitudes_and_tries_are_kept(spark):
    frames = crystal(spark, 2)
    plan = spark.createDataFrame([(10, 0, "atomic_displacement", ["atomic_displacement"], [0.01, 0.05, 0.05]), (11, 0, "atomic_displacement", ["atomic_displacement"], [2.0, 0.05, 0.05]),
                                  (12, 1, "antisite_swap", ["antisite_swap", "vacancy"], [0.1, 0.1, 0.1])],
                                 "i bigint, parent bigint, operator string, tries array<string>, genes array<double>")
    made = {r["i"]: r for r in mutations.propose(plan, frames, {"atomic_displacement": {"max_sigma": 0.5}}, mutations.Rules(min_distance_mode="none"), 1).collect()}
    base = np.array(frames.where("i = 0").first()["positions"])
    moved = [np.abs(np.array(made[k]["positions"]) - base).max() for k in (10, 11)]
    assert 0 < moved[0] < 0.06 and moved[1] > 0.06 and made[12]["operator"] == "antisite_swap"


def test_random_parents_do_not_repeat():
    rng = np.random.default_rng(0)
    assert sorted(search.chosen_parents([1, 2, 3, 4], [], 4, rng)) == [1, 2, 3, 4]
    got = search.chosen_parents([1, 2, 3, 4], [50, 51, 52], 4, rng)
    assert len(set(got)) == 4 and sum(g >= 50 for g in got) == 2
    assert sorted(search.chosen_parents([1], [50, 51, 52], 4, rng)) == [1, 50, 51, 52]
    assert search.chosen_parents([1, 2], [], 3, rng, np.array([0.0, 1.0])) == [2, 2, 2]


@pytest.mark.parametrize("target", [False, True])
def test_genetic_run_prunes_its_pool_and_resumes_from_the_middle(spark, tmp_path, target):
    frames = crystal(spark, 2)
    descriptor = radial_histogram(4.0, 6)
    settings = search.Settings(optimizer="genetic", operators={"atomic_displacement": {}, "cell_shear": {}}, children_per_seed=6, batch_accept=6,
                               breeding=breeding.Breeding(weigh_success=True))
    near = None
    if target:
        from vectorloom.functions.descriptors import compute
        from vectorloom.operators.profile import pooled

        rows = compute(frames.where("i = 1").withColumnRenamed("i", "frame_index"), descriptor)
        near = (pooled(rows, "frame").withColumnRenamed("frame", "i"), 5.0)

    def go(rounds, resume=False):
        budget = search.Budget(max_generations=3, max_evaluations=500)
        return search.run(frames, frames, descriptor, settings, budget, folder=str(tmp_path / rounds), target_radius=near, resume=resume)

    whole = go("a")
    assert len(whole.rounds) == 3 and sum(r.accepted for r in whole.rounds) > 8
    sizes = [spark.read.parquet(str(tmp_path / "a" / f"pool-{g}")).count() for g in range(3)]
    assert sizes[-1] == 8 and sizes == sorted(sizes)
    bred = [r["parent"] for r in whole.accepted.where("generation > 0").collect()]
    if target:
        # Its own seed is at the target and so outweighs the other one.
        assert bred.count(1) > bred.count(0)
    else:
        assert set(bred) - {0, 1}, "accepted structures become parents"
    again = go("a", resume=True)
    assert [r.best_fitness for r in again.rounds] == [r.best_fitness for r in whole.rounds]


def test_empty_frames_have_no_parents(spark):
    empty = frame_of(spark, np.zeros((0, 2)))
    assert breeding.renewed(breeding.newborn(spark), empty.selectExpr("i AS place", "i", "features AS at", "features AS genes", "features AS shares"), 4).count() == 0
