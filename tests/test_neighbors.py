import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import frame_of
from vectorloom.operators import neighbors as nn
from vectorloom.session import BROADCAST_BYTES_KEY


def brute(r, q, k, metric, skip_self):
    out = []
    for a, v in enumerate(q):
        if metric == "euclidean":
            d = np.sqrt(((r - v) ** 2).sum(1))
        elif metric == "manhattan":
            d = np.abs(r - v).sum(1)
        else:
            d = np.maximum(1 - (r @ v) / np.maximum(np.linalg.norm(r, axis=1) * np.linalg.norm(v), 1e-15), 0)
        ids = [j for j in np.lexsort((np.arange(len(r)), np.round(d, 12))) if not (skip_self and j == a)]
        out.append((ids[:k], d[ids[:k]]))
    return out


def table(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    if kind == "copies":
        x[100:200] = x[7]
    if kind == "offset":
        x = x + 1e6
    if kind == "clusters":
        x = x * 0.05 + rng.integers(0, 6, size=(300, 1)) * 10.0
    return x


@pytest.mark.parametrize("kind", ["plain", "copies", "offset", "clusters"])
@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("form", ["broadcast", "blocks"])
def test_matches_brute_force(spark, kind, metric, form):
    x = table(kind)
    df = frame_of(spark, x)
    if form == "broadcast":
        found = nn._scan_small(df, df, 4, metric, True)
    else:
        found = nn._scan_blocks(df, df, 4, metric, True, 12)
    got = {r["i"]: r for r in found.collect()}
    assert len(got) == len(x)
    for i, (_ids, d) in enumerate(brute(x, x, 4, metric, True)):
        assert i not in got[i]["indices"]
        np.testing.assert_allclose(got[i]["distances"], d, rtol=1e-9, atol=1e-9)
        if kind == "copies" and 100 <= i < 200:
            expected = [j for j in [7, *range(100, 200)] if j != i][:4]
            assert got[i]["indices"] == expected


def test_cosine_and_two_sets(spark, monkeypatch):
    x = table("plain")
    r, q = frame_of(spark, x[:200]), frame_of(spark, x[200:])
    small = {a["i"]: a for a in nn.nearest(r, q, 3, "cosine").collect()}
    spark.conf.set(BROADCAST_BYTES_KEY, "4096")
    try:
        large = {a["i"]: a for a in nn.nearest(r, q, 3, "cosine", cell_rows=30).collect()}
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    for i, (ids, d) in enumerate(brute(x[:200], x[200:], 3, "cosine", False)):
        assert small[i]["indices"] == ids and large[i]["indices"] == ids
        np.testing.assert_allclose(large[i]["distances"], d, rtol=1e-9)


def test_radius_counts_agree_in_both_forms(spark):
    x = table("clusters")
    df = frame_of(spark, x)
    small = dict(nn.within_radius(df, df, 0.2).collect())
    spark.conf.set(BROADCAST_BYTES_KEY, "4096")
    try:
        large = dict(nn.within_radius(df, df, 0.2).collect())
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {i: int(n) for i, n in enumerate((d <= 0.2).sum(1))}
    assert small == want and large == want


def test_k_beyond_rows(spark):
    df = frame_of(spark, np.arange(6.0).reshape(3, 2))
    assert all(len(r["indices"]) == 2 for r in nn.self_nearest(df, 10).collect())


def test_fuzzy_graph_is_a_union(spark):
    from vectorloom.operators import graph

    x = table("plain")[:60]
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 1:6]
    offset, width = graph.row_widths(d)
    np.testing.assert_allclose(np.exp(-np.maximum(d - offset[:, None], 0) / width[:, None]).sum(1), np.log2(6), rtol=1e-6)
    rows = graph.fuzzy_graph(frame_of(spark, x), {"n_neighbors": 6}).collect()
    assert all(r["a"] < r["b"] and 0 < r["weight"] <= 1 for r in rows)
    assert len({(r["a"], r["b"]) for r in rows}) == len(rows)


def test_rows_meet_few_cells_however_many_there_are(spark):
    """On clustered rows the cells that a row meets do not grow with their number."""
    rng = np.random.default_rng(9)
    met = []
    for groups in (20, 80):
        x = (rng.normal(size=(groups, 1, 6)) * 100 + rng.normal(size=(groups, 25, 6))).reshape(-1, 6)
        df = nn._metric_space(frame_of(spark, x), "euclidean")
        tree = nn.BlockTree(df, df, "euclidean", 10)
        assert len(tree.pivots) == len(x) // 10 and tree.count.sum() == len(x)
        found = tree.reachable(tree.query.withColumn("limit", F.lit(6.0)), 0, None)
        met.append(found.count() / len(x))
        pairs = {tuple(r) for r in found.collect()} | {(r["i"], r["cell"]) for r in tree.query.collect()}
        cell = {r["i"]: r["cell"] for r in tree.reference.collect()}
        near = np.argwhere(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 6.0)
        assert all((i, cell[j]) in pairs for i, j in near.tolist())
    assert met[1] < 1.5 * met[0]


def test_order_of_cells_is_kept_between_waves(spark):
    x = table("plain")
    df = nn._metric_space(frame_of(spark, x), "euclidean")
    tree = nn.BlockTree(df, df, "euclidean", 15)
    asked = tree.query.withColumn("limit", F.lit(4.0))
    parts = [{tuple(r) for r in tree.reachable(asked, a, b).collect()} for a, b in ((0, 2), (2, 5), (5, None))]
    assert set.union(*parts) == {tuple(r) for r in tree.reachable(asked, 0, None).collect()}
    assert sum(map(len, parts)) == len(set.union(*parts))
    tighter = {tuple(r) for r in tree.reachable(asked.withColumn("limit", F.lit(2.0)), 0, 2).collect()}
    assert tighter <= parts[0]


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e6])
def test_rounded_coordinates_only_screen_manhattan_distances(monkeypatch, scale):
    rng = np.random.default_rng(5)
    r = rng.normal(size=(700, 64)) * scale
    r[::50, 3] *= 1e4  # a far coordinate makes the steps coarse
    r[100:140] = r[7]
    q, ids = r[:90], rng.permutation(700)
    met, plain = [], nn.pair_distances
    monkeypatch.setattr(nn, "pair_distances", lambda *a: met.append(a) or plain(*a))
    at, found, dist = nn.nearest_block(q, ids[:90], r, ids, 6, "manhattan", True)
    assert not met
    d = plain(q, r, "manhattan")
    for k in range(90):
        order = [j for j in np.lexsort((ids, d[k])) if j != k][:6]
        assert found[at == k].tolist() == ids[order].tolist() and (dist[at == k] == d[k][order]).all()


def test_query_rows_are_dealt_and_slices_agree_with_one_scan(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, size=(2100, 10)).astype(float)  # many ties and copies
    ids = [int(k) // 2 for k in range(2100)]  # every id twice
    df = frame_of(spark, x, ids).coalesce(1)
    whole = sorted(map(tuple, nn.self_nearest(df, 5, "manhattan").collect()))
    monkeypatch.setattr(nn, "TASK_PAIRS", 1 << 20)
    assert nn.self_nearest(df, 5, "manhattan").rdd.getNumPartitions() > 1
    monkeypatch.setattr(nn, "_scan_blocks", None)
    spark.conf.set(BROADCAST_BYTES_KEY, str(40 << 10))
    try:
        assert sorted(map(tuple, nn.self_nearest(df, 5, "manhattan").collect())) == whole
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    assert len(whole) == 2100
