import itertools

import numpy as np
import pytest

from vectorloom.operators.correlation import clustered_order, linkage_tree, optimal_leaves


def length(order, apart):
    return sum(apart[a, b] for a, b in itertools.pairwise(order))


def every_turn(merges, size):
    """All orders that turning subtrees can give."""
    orders = {k: [[k]] for k in range(size)}
    for n, (a, b) in enumerate(merges):
        orders[size + n] = [x + y for p, q in ((a, b), (b, a)) for x in orders[p] for y in orders[q]]
    return orders[size + len(merges) - 1]


@pytest.mark.parametrize("seed,size", [(s, n) for s in range(12) for n in (2, 3, 5, 8)])
def test_no_turn_of_subtrees_is_shorter(seed, size):
    r = np.corrcoef(np.random.default_rng(seed).normal(size=(size, size + 3)))
    gap = 1 - np.abs(r)
    merges = linkage_tree(gap)
    order = optimal_leaves(merges, gap)
    turns = every_turn(merges, size)
    assert order in turns and length(order, gap) == pytest.approx(min(length(t, gap) for t in turns), abs=1e-12)
    assert order[0] < order[-1]


def test_ties_chains_and_small_tables():
    assert optimal_leaves([], np.zeros((0, 0))) == [] and optimal_leaves([], np.zeros((1, 1))) == [0]
    assert sorted(optimal_leaves(linkage_tree(np.zeros((6, 6))), np.zeros((6, 6)))) == list(range(6))
    # A chain of merges, deeper than a recursion would go.
    size = 1200
    x = np.cumsum(np.arange(size, dtype=float))
    gap = np.abs(x[:, None] - x[None, :])
    merges = [(0, 1), *[(size + k, k + 2) for k in range(size - 2)]]
    assert optimal_leaves(merges, gap)[:3] == [0, 1, 2]


def test_alike_features_stand_together():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 400))
    x = np.array([base[k % 3] + rng.normal(scale=0.1, size=400) for k in range(9)])
    order = clustered_order({"features": np.arange(10, 19), "matrix": np.corrcoef(x)})
    assert [len(list(g)) for _k, g in itertools.groupby((f - 10) % 3 for f in order)] == [3, 3, 3]
