import numpy as np
import pytest

from conftest import frame_of
from vectorloom.operators import clusters, correlation, crossset, outliers, spectrum
from vectorloom.session import BROADCAST_BYTES_KEY


def blobs(n=120, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 3)) * 0.4 + np.repeat([[0, 0, 0], [6, 0, 0], [0, 6, 0]], n // 3, axis=0)


def dbscan_by_hand(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    number = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = number
            while stack:
                v = stack.pop()
                for w in np.flatnonzero(near[v]):
                    if label[w] < 0:
                        label[w] = number
                        if core[w]:
                            stack.append(w)
            number += 1
    return label


@pytest.mark.parametrize("form", ["broadcast", "pivots"])
def test_dbscan_matches_definition(spark, form):
    x = np.vstack([blobs(), blobs()[:20], [[50.0, 0, 0]]])
    df = frame_of(spark, x)
    if form == "pivots":
        spark.conf.set(BROADCAST_BYTES_KEY, "2048")
    try:
        got = dict(clusters.dbscan(df, {"eps": 0.5, "min_samples": 5, "preprocess": "raw"}).collect())
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    assert [got[k] for k in range(len(x))] == dbscan_by_hand(x, 0.5, 5).tolist()


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_components(spark, small):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (101, 100), (200, 200), (31, 15), (40, 41)]
    found = dict(clusters.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), small).collect())
    assert {found[k] for k in range(32)} == {0} and found[101] == 100 and found[200] == 200 and found[41] == 40


@pytest.mark.parametrize("rows", [1, 1000])
def test_ward_matches_one_merge_at_a_time(spark, rows):
    x = np.random.default_rng(2).normal(size=(40, 3))
    groups = {k: [k] for k in range(40)}
    while len(groups) > 5:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    u, v = x[groups[a]], x[groups[b]]
                    c = len(u) * len(v) / (len(u) + len(v)) * ((u.mean(0) - v.mean(0)) ** 2).sum()
                    best = min(best or (np.inf,), (c, a, b))
        groups[best[1]] += groups.pop(best[2])
    got = dict(clusters.ward(frame_of(spark, x), {"n_clusters": 5, "preprocess": "raw"}, local_rows=rows).collect())
    assert {frozenset(v) for v in groups.values()} == {frozenset(k for k in got if got[k] == g) for g in set(got.values())}


def test_blobs_are_found_by_every_clustering(spark):
    x = blobs()
    df = frame_of(spark, x)
    truth = np.repeat([0, 1, 2], 40)
    fits = [clusters.kmeans(df, {"n_clusters": 3, "preprocess": "raw"})["labels"], clusters.single_linkage(df, {"n_clusters": 3, "preprocess": "raw"}), clusters.hdbscan(df, {"min_cluster_size": 8, "preprocess": "raw"})]
    for fit in fits:
        got = {r["i"]: r["label"] for r in fit.collect()}
        kept = [k for k in range(120) if got[k] >= 0]
        assert len(kept) > 90 and all((got[a] == got[kept[0]]) == (truth[a] == truth[kept[0]]) for a in kept)
    distributed = clusters._gathered_sums(df, {0: x[:3]})
    np.testing.assert_allclose(distributed[0], clusters._partial_sums(x, {0: x[:3]})[0])


@pytest.mark.parametrize("tasks", [None, 3])
def test_rounds_over_packed_rows_keep_every_row(spark, monkeypatch, tasks):
    x, centres = blobs(), {0: blobs()[:3], 4: blobs()[50:52]}
    monkeypatch.setattr(clusters, "BLOCK_BYTES", 7 * 24)
    packed = clusters._packed(frame_of(spark, x).repartition(5)).coalesce(3)
    blocks = packed.collect()
    assert sum(r["n"] for r in blocks) == len(x) and max(r["n"] for r in blocks) == 7
    found = clusters._block_sums(packed, centres, tasks)
    for run, plain in clusters._partial_sums(x, centres).items():
        np.testing.assert_allclose(found[run], plain)


def test_outliers_see_the_far_row(spark):
    x = np.vstack([blobs(), [[30.0, 30.0, 30.0]]])
    df = frame_of(spark, x)
    for name in outliers.ALGORITHMS:
        rows = outliers.ALGORITHMS[name](df, {"contamination": 0.01}).collect()
        assert max(rows, key=lambda r: r["score"])["i"] == 120, name
    z = (x - x.mean(0)) / x.std(0)
    inverse = np.linalg.pinv(np.cov(z, rowvar=False) + np.eye(3) * 1e-10)
    got = {r["i"]: r["score"] for r in outliers.mahalanobis(df).collect()}
    gap = z - z.mean(0)
    np.testing.assert_allclose([got[k] for k in range(121)], np.sqrt(np.einsum("ij,jk,ik->i", gap, inverse, gap)), rtol=1e-8)


def test_spectra_match_svd(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) * np.arange(1, 6)
    df = frame_of(spark, x)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    found = spectrum.pca(df)
    np.testing.assert_allclose(found.explained, s**2 / (s**2).sum(), rtol=1e-8)
    coords = np.array([r["coords"] for r in found.table.orderBy("i").collect()])
    np.testing.assert_allclose(np.abs(coords), np.abs((x - x.mean(0)) @ vt[:2].T), rtol=1e-6, atol=1e-8)
    for mode, y in (("raw", x), ("center", x - x.mean(0)), ("standardized", (x - x.mean(0)) / x.std(0))):
        v = np.linalg.svd(y, compute_uv=False) ** 2
        p = v / v.sum()
        assert spectrum.effective_dimension(df, {"preprocess": mode})["participation_ratio"] == pytest.approx(1 / (p * p).sum())
    kernel = spectrum.kernel_spectrum(df, {"kernel": "linear", "preprocess": "center"})
    np.testing.assert_allclose(kernel["eigenvalues"][:5], s**2, rtol=1e-8)


def test_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)) * [1, 5, 0.2, 3] + 2
    y = x @ [1.0, -0.3, 4.0, 0.1] + rng.normal(size=90) * 0.1
    df = spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(90)], "i bigint, features array<double>, y double")
    rows = {r["i"]: r for r in correlation.cross_validated(df, "y", {"folds": 3, "alpha": 2.0}).collect()}
    fold = np.array([rows[k]["fold"] for k in range(90)])
    for f in range(3):
        train = fold != f
        z = (x - x[train].mean(0)) / x[train].std(0)
        w = np.linalg.solve(z[train].T @ z[train] + 2.0 * np.eye(4), z[train].T @ (y[train] - y[train].mean()))
        np.testing.assert_allclose([rows[k]["prediction"] for k in np.flatnonzero(~train)], z[~train] @ w + y[train].mean(), rtol=1e-6)
    assert correlation.scores(correlation.cross_validated(df, "y"))["r2"] > 0.9


def test_mantel_and_imbalance(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(40, 3))
    left, right, other = frame_of(spark, a), frame_of(spark, a * 2 + 1), frame_of(spark, rng.normal(size=(40, 3)))
    same = crossset.mantel(left, right, {"permutations": 49, "method": "spearman"})
    assert same["statistic"] == pytest.approx(1.0) and same["p_value"] == pytest.approx(1 / 50)
    assert crossset.mantel(left, other, {"permutations": 49})["p_value"] > 0.05
    assert crossset.information_imbalance(left, right)["delta_a_to_b"] == 0.0
    assert crossset.information_imbalance(left, other)["delta_a_to_b"] > 0.2
    picks = crossset.acquire(left, other, {"n_samples": 10})
    scores = [s for _i, s in picks]
    assert len({i for i, _s in picks}) == 10 and all(x >= y - 1e-12 for x, y in zip(scores, scores[1:]))
