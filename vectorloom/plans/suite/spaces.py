"""Neighbours, trajectories, outliers, clusters, spectra and two-set comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import vec
from ...operators import clusters, correlation, crossset, graph, information, outliers, preprocess, sampling, spectrum
from ...operators import neighbors as nn
from ...operators import trajectory as tj
from ...session import BROADCAST_BYTES_KEY
from .inputs import RAW, embeddings, half, query_side, r6, reference_side, standardized, table, tidy


def _standard(spark, sf):
    df = embeddings(spark, sf)
    return preprocess.fit(df).apply(df).select("i", "features", "label")


def _one_row(spark, **values):
    names = ", ".join(f"`{k}` {'bigint' if isinstance(v, int) else 'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    return tidy(spark.createDataFrame([tuple(values.values())], names))


def neighbors(metric):
    def run(spark, sf):
        found = nn.exploded(nn.self_nearest(embeddings(spark, sf), 10, metric))
        return tidy(found)
    return run


# A broadcast bound that no set of embeddings is within.
NO_BROADCAST_BYTES = 1 << 14


def in_blocks(query):
    """The query in the form for references beyond the broadcast bound."""
    def run(spark, sf):
        had = spark.conf.get(BROADCAST_BYTES_KEY, None)
        spark.conf.set(BROADCAST_BYTES_KEY, str(NO_BROADCAST_BYTES))
        try:
            return query(spark, sf)
        finally:
            spark.conf.unset(BROADCAST_BYTES_KEY) if had is None else spark.conf.set(BROADCAST_BYTES_KEY, had)
    return run


def similarity(metric):
    def run(spark, sf):
        return tidy(nn.similar_to(embeddings(spark, sf), 0, 10, metric))
    return run


def cross_nearest(metric, k):
    def run(spark, sf):
        df = embeddings(spark, sf)
        pair = crossset.scaled_pair(reference_side(df), query_side(df), {"metric": metric})
        return tidy(nn.exploded(nn.nearest(pair.reference, pair.query, k, metric)))
    return run


def pairwise(spark, sf):
    """Every row of the distance matrix, summarised where it is made."""
    df = embeddings(spark, sf).select("i", "features")
    found = nn.broadcast_reduce(
        df.withColumn("tag", F.lit(0).cast("bigint")), df, _cosine_row, "i bigint, low double, total double, high double, n bigint",
        lambda parts: parts.groupBy("i").agg(
            F.min("low").alias("low"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("high").alias("high")))
    return tidy(found)


def _cosine_row(q_ids, q, _qt, r_ids, r, _rt):
    import numpy as np

    d = nn.pair_distances(q, r, "cosine")
    d[q_ids[:, None] == r_ids[None, :]] = 0.0
    off = np.where(q_ids[:, None] == r_ids[None, :], np.inf, d)
    return q_ids, off.min(axis=1), d.sum(axis=1), d.max(axis=1), np.full(len(q_ids), len(r_ids), np.int64)


def closest_pairs(spark, sf):
    """Unordered neighbour pairs, once each, closest first."""
    edges = nn.exploded(nn.self_nearest(embeddings(spark, sf), 8))
    pairs = edges.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("distance").alias("distance"))
    return tidy(pairs.orderBy("distance", "a", "b").limit(50))


def lexicographic(spark, sf):
    return embeddings(spark, sf).orderBy("features", "i").select("i").limit(100)


# --- trajectories ------------------------------------------------------------


def _series(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return table(spark, sf, "events").select(F.col("event_id").alias("i"), "user_id", F.array("value", k).alias("features"))


def user_steps(spark, sf):
    return tidy(tj.steps(_series(spark, sf), "i", 1.0, ("user_id",)).select("i", "step_distance", "speed"))


def user_reference(spark, sf):
    return tidy(tj.reference_distance(_series(spark, sf), "i", ("user_id",)).select("i", "reference_distance"))


def user_path(spark, sf):
    return tidy(tj.cumulative_distance(tj.steps(_series(spark, sf), "i", 1.0, ("user_id",)), "i", ("user_id",)).select("i", "cumulative_distance"), 4)


def series_steps(spark, sf):
    return tidy(tj.cumulative_distance(tj.steps(_standard(spark, sf)), "i").select("i", "step_distance", "speed", "cumulative_distance"), 5)


def series_events(method):
    def run(spark, sf):
        stepped = tj.steps(_series(spark, sf), "i").persist()
        found = tj.events(stepped, tj.event_threshold(stepped, {"event_method": method}))
        return tidy(found)
    return run


def series_threshold(spark, sf):
    stepped = tj.steps(_standard(spark, sf)).persist()
    t = tj.event_threshold(stepped)
    stepped.unpersist()
    return _one_row(spark, median=t.median, mad=t.mad, mean=t.mean, std=t.std, threshold=t.value)


def decimated(spark, sf):
    return tj.decimated(_series(spark, sf).select("i"), 4000).select("i")


def shown(spark, sf):
    return tj.display_window(_series(spark, sf).select("i"), 100, 10**9, 7).select("i")


# --- outliers and clusters ---------------------------------------------------


def outlier(name, **params):
    def run(spark, sf):
        return tidy(outliers.ALGORITHMS[name](embeddings(spark, sf), params))
    return run


def dbscan(spark, sf):
    return clusters.dbscan(embeddings(spark, sf), {"eps": 9.7, "min_samples": 5})


def dbscan_summary(spark, sf):
    return clusters.cluster_summary(dbscan(spark, sf))


def kmeans(spark, sf):
    return clusters.kmeans(embeddings(spark, sf), {"n_clusters": 6})["labels"]


def agglomerative(spark, sf):
    return clusters.ward(embeddings(spark, sf), {"n_clusters": 6})


def single(spark, sf):
    return clusters.single_linkage(embeddings(spark, sf), {"n_clusters": 6})


def hdbscan(spark, sf):
    return tidy(clusters.hdbscan(embeddings(spark, sf), {"min_cluster_size": 5}))


# --- spectra -----------------------------------------------------------------


def pca(spark, sf):
    p = spectrum.pca(embeddings(spark, sf))
    return tidy(p.table.select("i", F.col("coords")[0].alias("pc1"), F.col("coords")[1].alias("pc2")))


def pca_variance(spark, sf):
    p = spectrum.pca(embeddings(spark, sf))
    return tidy(spark.createDataFrame([(k, float(v)) for k, v in enumerate(p.explained)], "component int, share double"))


def pca_total(spark, sf):
    """Total variance and how far one component's share departs from even."""
    p = spectrum.second_moments(embeddings(spark, sf))
    c = p.covariance
    return _one_row(spark, total_variance=float(c.trace()), squared_norm=float((c * c).sum()))


def visual_plane(spark, sf):
    return tidy(spectrum.visual_plane(_standard(spark, sf)).select("i", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")))


def participation(spark, sf):
    found = spectrum.effective_dimension(embeddings(spark, sf), {"preprocess": "center"})
    return _one_row(spark, participation_ratio=found["participation_ratio"])


def components_needed(spark, sf):
    found = spectrum.effective_dimension(embeddings(spark, sf))
    return spark.createDataFrame([(float(t), int(n)) for t, n in found["components"].items()], "share double, components int")


def kernel(spark, sf):
    rows = spectrum.kernel_rows(embeddings(spark, sf))
    return tidy(rows.select("i", F.array_min("kernel").alias("low"), F.array_max("kernel").alias("high"), vec.row_mean(F.col("kernel")).alias("mean")))


def kernel_rank(spark, sf):
    found = spectrum.kernel_spectrum(embeddings(spark, sf), {"max_samples": 2000})
    return _one_row(spark, effective_rank=found["effective_rank"], top=found["top_eigenvalue_fraction"])


def two_nn(spark, sf):
    rows = spectrum.neighbor_ratios(embeddings(spark, sf))
    return tidy(rows.agg((1 / F.avg("ln_mu")).alias("dimension"), F.count(F.lit(1)).alias("points")))


def two_nn_bootstrap(spark, sf):
    found = spectrum.two_nn_dimension(embeddings(spark, sf))
    b = found["bootstrap"]
    return _one_row(spark, dimension=found["intrinsic_dimension"], mean=b["mean"], sd=b["sd"], low=b["ci95"][0], high=b["ci95"][1])


# --- correlation -------------------------------------------------------------


def feature_pairs(method):
    def run(spark, sf):
        found = correlation.feature_correlation(embeddings(spark, sf), {"method": method})
        return tidy(spark.createDataFrame(correlation.top_pairs(found, 50), "a int, b int, r double"))
    return run


def redundant(spark, sf):
    found = correlation.redundancy(correlation.feature_correlation(embeddings(spark, sf)), 0.1)
    return _one_row(spark, pairs=found["pairs"], groups=found["groups"], features=len(found["features"]))


def feature_order(spark, sf):
    order = correlation.clustered_order(correlation.feature_correlation(embeddings(spark, sf)))
    return spark.createDataFrame(list(enumerate(order)), "place int, feature int")


def _lines_with_price(spark, sf):
    lines = table(spark, sf, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return lines.select(F.xxhash64(key).alias("i"), F.array("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double")).alias("features"),
                        F.col("l_extendedprice").alias("price"))


def property_pearson(spark, sf):
    return tidy(correlation.property_pearson(correlation.with_target(_lines_with_price(spark, sf), "price")))


def property_spearman(spark, sf):
    return tidy(correlation.property_spearman(correlation.with_target(_lines_with_price(spark, sf), "price")))


def information_of_sum(spark, sf):
    """What each coordinate tells of the sum of all."""
    df = embeddings(spark, sf).withColumn("y", F.aggregate("features", F.lit(0.0), lambda a, x: a + x))
    return tidy(information.mutual_information(correlation.with_target(df, "y")))


def _held_out(spark, sf):
    df = embeddings(spark, sf).withColumn("y", F.col("label").cast("double"))
    return correlation.cross_validated(df, "y")


def ridge_scores(spark, sf):
    return _one_row(spark, **correlation.scores(_held_out(spark, sf)))


def reliability(spark, sf):
    return tidy(correlation.reliability(_held_out(spark, sf).persist())["bins"])


def distance_property(spark, sf):
    df = embeddings(spark, sf).withColumn("y", F.col("label").cast("double"))
    return tidy(correlation.distance_versus_property(df, "y"))


def verdicts(spark, sf):
    """Verdict per feature taken as a one-column model of the price."""
    r = correlation.property_pearson(correlation.with_target(_lines_with_price(spark, sf), "price"))
    r2 = F.col("pearson") * F.col("pearson")
    return r.select("f", F.when(r2 >= correlation.STRONG_R2, "strong").when(r2 >= correlation.MODERATE_R2, "moderate").otherwise("weak").alias("encoding"))


def guarded(spark, sf):
    lines = table(spark, sf, "lineitem")
    return tidy(lines.groupBy("l_returnflag").agg(
        correlation.guarded("l_quantity", "l_extendedprice").alias("usual"),
        correlation.guarded(F.col("l_quantity") * 0, "l_extendedprice").alias("flat")))


# --- two sets ----------------------------------------------------------------


def _sides(spark, sf):
    df = embeddings(spark, sf)
    return reference_side(df), query_side(df)


def coverage(spark, sf):
    return tidy(crossset.coverage(*_sides(spark, sf))["table"])


def coverage_counts(spark, sf):
    return tidy(crossset.label_counts(crossset.coverage(*_sides(spark, sf))["table"]))


def overlap(spark, sf):
    return tidy(crossset.overlap(*_sides(spark, sf))["table"])


def uncertainty(spark, sf):
    scored, _pair = crossset.acquisition_scores(*_sides(spark, sf), {"acquisition_method": "uncertainty_diversity"})
    return tidy(scored)


def pool(spark, sf):
    reference, query = _sides(spark, sf)
    scored, _pair = crossset.acquisition_scores(reference, query)
    return tidy(crossset.acquisition_pool(scored, 20, 5.0, query.count()).select("i", "novelty"))


def acquired(spark, sf):
    picks = crossset.acquire(*_sides(spark, sf), {"n_samples": 50})
    return tidy(spark.createDataFrame([(n, i, s) for n, (i, s) in enumerate(picks)], "pick int, i bigint, score double"))


def drift(spark, sf):
    found = crossset.drift(*_sides(spark, sf), {})
    return _one_row(spark, mmd2=found["mmd2"], bandwidth=found["bandwidth"], centroid_distance=found["centroid_distance"], covariance_shift=found["covariance_shift"])


def _halves(spark, sf):
    df = embeddings(spark, sf).select("i", "features")
    return half(df, "left"), half(df, "right")


def alignment(spark, sf):
    return _one_row(spark, aligned=crossset.require_aligned(*_halves(spark, sf)))


def mantel(spark, sf):
    found = crossset.mantel(*_halves(spark, sf), {"permutations": 99})
    return _one_row(spark, statistic=found["statistic"], pairs=found["pair_count"])


def mantel_rank(spark, sf):
    found = crossset.mantel(*_halves(spark, sf), {"max_samples": 2000, "permutations": 99, "method": "spearman"})
    return _one_row(spark, statistic=found["statistic"], p_value=found["p_value"])


def compare(spark, sf):
    found = crossset.compare(*_halves(spark, sf), {"max_samples": 2000})
    return _one_row(spark, **{k: v for k, v in found.items()})


def sensitivity(spark, sf):
    """The second half of the coordinates as a second run, against the first."""
    from ...operators.diagnostics import run_sensitivity

    a, b = _halves(spark, sf)
    records = run_sensitivity({"left": a, "right": b}, {"max_samples": 2000})
    return tidy(spark.createDataFrame([(r["run"], r["rows"], r["effective_dimension"], r.get("neighbor_overlap")) for r in records],
                                      "run string, rows bigint, effective_dimension double, neighbor_overlap double"))


def overlap_knn(spark, sf):
    a, b = _halves(spark, sf)
    return tidy(crossset.neighbor_overlap(preprocess.fit(a).apply(a), preprocess.fit(b).apply(b), 10))


def imbalance(spark, sf):
    found = crossset.information_imbalance(*_halves(spark, sf))
    return tidy(found["forward"])


def imbalance_overlap(spark, sf):
    found = crossset.information_imbalance(*_halves(spark, sf))
    return tidy(found["overlap"].agg(*[F.avg(f"overlap_{k}").alias(f"overlap_{k}") for k in found["sizes"]]))


def rand_index(spark, sf):
    lines = table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"))
    value = crossset.adjusted_rand(lines.select("i", F.col("a").alias("label")), lines.select("i", F.col("b").alias("label")))
    return tidy(spark.createDataFrame([(value,)], "ari double"), 8)


def joint_plane(spark, sf):
    return tidy(spectrum.joint_plane(*_sides(spark, sf)).select("i", "source", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")))


def fuzzy_edges(spark, sf):
    return tidy(graph.fuzzy_graph(embeddings(spark, sf)))


# --- sampling ----------------------------------------------------------------


def fps(spark, sf):
    run = sampling.sample(embeddings(spark, sf), "fps", {"n_samples": 64})
    return tidy(spark.createDataFrame(list(zip(range(len(run.ids)), run.ids, run.distances, run.radius_curve, run.mean_curve, run.r2_curve)),
                                      "pick int, i bigint, distance double, radius double, mean double, r2 double"))


def fps_raw(spark, sf):
    run = sampling.sample(embeddings(spark, sf), "fps", {"n_samples": 25, "scaling": "raw", "initialization": "first"})
    return tidy(spark.createDataFrame(list(zip(range(len(run.ids)), run.ids, run.distances)), "pick int, i bigint, distance double"))


def fps_stop(spark, sf):
    run = sampling.sample(embeddings(spark, sf), "fps", {"n_samples": 400, "target_coverage": 0.3})
    return spark.createDataFrame([(len(run.ids), run.stopped_by)], "picked int, stopped_by string")


def fps_warm(spark, sf):
    df = embeddings(spark, sf)
    run = sampling.sample(query_side(df), "fps", {"n_samples": 20, "scaling": "standardized"}, existing=reference_side(df))
    return tidy(spark.createDataFrame(list(zip(range(len(run.ids)), run.ids, run.distances)), "pick int, i bigint, distance double"))


def fps_residuals(spark, sf):
    run = sampling.sample(embeddings(spark, sf), "fps", {"n_samples": 64})
    return tidy(sampling.residual_statistics(run))


def fps_grouped(spark, sf):
    run = sampling.sample(embeddings(spark, sf), "fps", {"n_samples": 40, "strategy": "grouped"}, group="label")
    return tidy(spark.createDataFrame(list(zip(range(len(run.ids)), run.ids, run.r2_curve)), "pick int, i bigint, r2 double"))


def quotas(spark, sf):
    sizes = sampling.group_sizes(table(spark, sf, "documents"), "lang")
    shares = sampling.sqrt_quota(list(sizes.values()), 100)
    return spark.createDataFrame([(g, n, q) for (g, n), q in zip(sizes.items(), shares)], "lang string, n bigint, quota bigint")


def stratified(spark, sf):
    picked = sampling.stratified(embeddings(spark, sf), "label", 100)
    return picked.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def random_rows(spark, sf):
    return sampling.random_rows(embeddings(spark, sf), 100).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("i").alias("distinct_n"))


def representatives(spark, sf):
    ids = sampling.sample(embeddings(spark, sf), "cluster_representative", {"n_samples": 30, "n_clusters": 6}).ids
    return spark.createDataFrame([(i,) for i in ids], "i bigint")


def composite(spark, sf):
    a, b = _halves(spark, sf)
    return tidy(vec.unpivot(sampling.composite({"a": a, "b": b}, {"b": 2.0}, "standardized"), "i"))


QUERIES = {
    "alg8_neighbors_euclidean": neighbors("euclidean"), "alg8_neighbors_cosine": neighbors("cosine"),
    "alg8_neighbors_manhattan": neighbors("manhattan"), "alg9_similarity_cosine": similarity("cosine"),
    "alg9_similarity_euclidean": similarity("euclidean"), "alg10_pairwise_rows": pairwise,
    "join6_nearest_reference": cross_nearest("euclidean", 1), "join7_k_nearest_reference": cross_nearest("manhattan", 5),
    "top2_closest_pairs": closest_pairs, "top6_lexicographic_order": lexicographic,
    "win1_user_steps": user_steps, "win2_reference_distance": user_reference, "win3_cumulative_distance": user_path,
    "win4_series_speed": series_steps, "win5_event_threshold": series_threshold, "win6_events_mad": series_events("mad"),
    "win7_events_percentile": series_events("percentile"), "win5_events_zscore": series_events("zscore"),
    "win9_decimation": decimated, "flt4_display_window": shown,
    "alg19_knn_outliers": outlier("knn"), "alg20_lof": outlier("lof"), "alg22_mahalanobis": outlier("mahalanobis"),
    "alg21_isolation_forest": outlier("isolation_forest"), "alg15_dbscan": dbscan, "alg18_cluster_summary": dbscan_summary,
    "alg14_kmeans": kmeans, "alg17_agglomerative": agglomerative, "alg17_single_linkage": single, "alg16_hdbscan": hdbscan,
    "alg1_pca": pca, "alg1_pca_variance": pca_variance, "alg1_total_variance": pca_total, "alg2_visual_plane": visual_plane,
    "alg6_participation_ratio": participation, "alg6_components_needed": components_needed, "alg5_kernel_rows": kernel,
    "alg5_kernel_spectrum": kernel_rank, "alg7_two_nn": two_nn, "alg7_two_nn_bootstrap": two_nn_bootstrap,
    "alg23_feature_pairs_pearson": feature_pairs("pearson"), "alg23_feature_pairs_spearman": feature_pairs("spearman"),
    "alg25_redundant_groups": redundant, "alg24_feature_order": feature_order, "alg26_property_pearson": property_pearson, "alg26_mutual_information": information_of_sum,
    "alg26_property_spearman": property_spearman, "alg26_ridge_scores": ridge_scores, "alg27_reliability": reliability,
    "alg28_distance_property": distance_property, "alg29_verdicts": verdicts, "alg30_guarded_correlation": guarded,
    "alg31_coverage": coverage, "alg31_coverage_counts": coverage_counts, "alg32_overlap": overlap, "alg34_uncertainty": uncertainty,
    "top7_acquisition_pool": pool, "alg33_acquisition": acquired, "alg37_drift": drift, "join3_alignment": alignment,
    "alg35_mantel": mantel, "alg35_mantel_spearman": mantel_rank, "alg36_compare": compare, "dia1_sensitivity": sensitivity, "join12_neighbor_overlap": overlap_knn,
    "alg38_information_imbalance": imbalance, "alg38_overlap_curve": imbalance_overlap, "alg36_rand_index": rand_index,
    "alg39_joint_plane": joint_plane, "alg3_fuzzy_graph": fuzzy_edges, "smp2_fps": fps, "smp2_fps_raw": fps_raw, "smp3_coverage_stop": fps_stop, "smp4_warm_start": fps_warm,
    "smp5_residuals": fps_residuals, "smp6_grouped": fps_grouped, "smp7_quota": quotas, "smp8_stratified": stratified,
    "smp1_random": random_rows, "smp9_cluster_representatives": representatives, "pre4_composite": composite,
}

LARGE = ("alg8_neighbors_euclidean", "alg8_neighbors_cosine", "alg8_neighbors_manhattan", "join6_nearest_reference", "join7_k_nearest_reference",
         "alg15_dbscan", "alg19_knn_outliers", "alg20_lof", "alg31_coverage")
QUERIES |= {f"{name}_large": in_blocks(QUERIES[name]) for name in LARGE}

COS = "greatest(1 - list_cosine_similarity(a.v, b.v), 0)"
L1 = "list_sum(list_transform(range(1, 65), lambda k: abs(a.v[k] - b.v[k])))"
L2 = "list_distance(a.v, b.v)"


def _knn_sql(distance: str, k: int) -> str:
    return f"""WITH {RAW}, d AS (SELECT a.i, b.i AS j, {distance} AS d FROM e a, e b WHERE a.i <> b.i),
 k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d)
 SELECT i, rank::INTEGER AS rank, j, round(d, 6) + 0.0 AS distance FROM k WHERE rank <= {k}"""


Z = standardized("e", "z")
R = standardized("e", "r", "label < 5")
Q = standardized("e", "q", "label >= 5", "label < 5")
SELF_Z = f"dd AS (SELECT a.i, b.i AS j, {L2} AS d FROM z a, z b WHERE a.i <> b.i)"
SERIES = "s AS (SELECT event_id AS i, user_id, value AS x, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS y FROM events)"
SETS = f"""{RAW}, {R}, {Q},
 rd AS (SELECT a.i, min({L2}) AS d FROM r a, r b WHERE a.i <> b.i GROUP BY a.i),
 qd AS (SELECT a.i, b.i AS j, {L2} AS d FROM q a, r b),
 nr AS (SELECT i, j AS nearest, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM qd) WHERE n = 1)"""
COVER = """lab AS (SELECT i, nearest, d, CASE WHEN d <= (SELECT quantile_cont(d, 0.95) FROM rd) THEN 0
 WHEN d <= (SELECT quantile_cont(d, 0.99) FROM rd) THEN 1 ELSE 2 END AS label FROM nr)"""
LEFT = "h1 AS (SELECT i, label, v[1:32] AS v FROM e)"
RIGHT = "h2 AS (SELECT i, label, v[33:64] AS v FROM e)"
HALVES = f"{RAW}, {LEFT}, {RIGHT}, {standardized('h1', 'za')}, {standardized('h2', 'zb')}"
STEP1 = "st AS (SELECT i, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM s WINDOW w AS (ORDER BY i)), ok AS (SELECT * FROM st WHERE d IS NOT NULL)"


SQL = {
    "alg8_neighbors_euclidean": _knn_sql(L2, 10), "alg8_neighbors_cosine": _knn_sql(COS, 10), "alg8_neighbors_manhattan": _knn_sql(L1, 10),
    "alg9_similarity_cosine": f"WITH {RAW}, a AS (SELECT * FROM e WHERE i = 0) SELECT b.i AS j, {r6(COS)} AS distance, {r6(f'1 - {COS}')} AS similarity "
    f"FROM a, e b WHERE b.i <> 0 ORDER BY {COS}, b.i LIMIT 10",
    "alg9_similarity_euclidean": f"WITH {RAW}, a AS (SELECT * FROM e WHERE i = 0) SELECT b.i AS j, {r6(L2)} AS distance, {r6(f'1 / (1 + {L2})')} AS similarity "
    f"FROM a, e b WHERE b.i <> 0 ORDER BY {L2}, b.i LIMIT 10",
    "alg10_pairwise_rows": f"WITH {RAW}, d AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 0 ELSE {COS} END AS d FROM e a, e b) "
    "SELECT i, round(min(d) FILTER (WHERE i <> j), 6) + 0.0 AS low, round(avg(d), 6) + 0.0 AS mean, round(max(d), 6) + 0.0 AS high FROM d GROUP BY i",
    "join6_nearest_reference": f"WITH {SETS} SELECT i, 1::INTEGER AS rank, nearest AS j, round(d, 6) + 0.0 AS distance FROM nr",
    "join7_k_nearest_reference": f"""WITH {RAW}, {R}, {Q}, d AS (SELECT a.i, b.i AS j, {L1} AS d FROM q a, r b),
 k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d) SELECT i, rank::INTEGER AS rank, j, round(d, 6) + 0.0 AS distance FROM k WHERE rank <= 5""",
    "top2_closest_pairs": f"""WITH {RAW}, d AS (SELECT a.i, b.i AS j, {L2} AS d FROM e a, e b WHERE a.i <> b.i),
 k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d)
 SELECT least(i, j) AS a, greatest(i, j) AS b, round(min(d), 6) + 0.0 AS distance FROM k WHERE rank <= 8 GROUP BY 1, 2 ORDER BY min(d), 1, 2 LIMIT 50""",
    "top6_lexicographic_order": f"WITH {RAW} SELECT i FROM e ORDER BY v, i LIMIT 100",
    "win1_user_steps": f"""WITH {SERIES}, g AS (SELECT i, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d, i - lag(i) OVER w AS dt
 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT i, round(d, 6) + 0.0 AS step_distance, round(coalesce(d / dt, 0), 6) + 0.0 AS speed FROM g""",
    "win2_reference_distance": f"""WITH {SERIES}, g AS (SELECT i, sqrt((x - first_value(x) OVER w) ** 2 + (y - first_value(y) OVER w) ** 2) AS d
 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT i, round(d, 6) + 0.0 AS reference_distance FROM g""",
    "win3_cumulative_distance": f"""WITH {SERIES}, g AS (SELECT i, user_id, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d
 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT i, round(sum(d) OVER (PARTITION BY user_id ORDER BY i), 4) + 0.0 AS cumulative_distance FROM g""",
    "win4_series_speed": f"""WITH {RAW}, {Z}, g AS (SELECT i, coalesce(list_distance(v, lag(v) OVER (ORDER BY i)), 0) AS d FROM z)
 SELECT i, round(d, 5) + 0.0 AS step_distance, round(d, 5) + 0.0 AS speed, round(sum(d) OVER (ORDER BY i), 5) + 0.0 AS cumulative_distance FROM g""",
    "win5_event_threshold": f"""WITH {RAW}, {Z}, g AS (SELECT list_distance(v, lag(v) OVER (ORDER BY i)) AS d FROM z), ok AS (SELECT d FROM g WHERE d IS NOT NULL),
 m AS (SELECT quantile_cont(d, 0.5) AS med, avg(d) AS mean, stddev_pop(d) AS std FROM ok), a AS (SELECT quantile_cont(abs(d - med), 0.5) AS mad FROM ok, m)
 SELECT round(med, 6) + 0.0 AS median, round(mad, 6) + 0.0 AS mad, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(med + 3 * 1.4826 * mad, 6) + 0.0 AS threshold FROM m, a""",
    "win9_decimation": """WITH p AS (SELECT event_id AS i, row_number() OVER (ORDER BY event_id) - 1 AS n, count(*) OVER () AS total FROM events)
 SELECT i FROM p WHERE n % greatest(1, ceil(total / 4000)::BIGINT) = 0 OR n = total - 1""",
    "flt4_display_window": "SELECT event_id AS i FROM events WHERE event_id >= 100 AND (event_id - 100) % 7 = 0",
    "alg19_knn_outliers": f"""WITH {RAW}, {Z}, {SELF_Z}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM dd),
 s AS (SELECT i, avg(d) AS score FROM k WHERE n <= 10 GROUP BY i)
 SELECT i, round(score, 6) + 0.0 AS score, (score > (SELECT quantile_cont(score, 0.99) FROM s))::INTEGER AS label FROM s""",
    "alg20_lof": f"""WITH {RAW}, {Z}, {SELF_Z}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM dd) WHERE n <= 20),
 kd AS (SELECT i, max(d) AS kd FROM k GROUP BY i), l AS (SELECT k.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM k JOIN kd ON kd.i = k.j GROUP BY k.i),
 s AS (SELECT k.i, avg(o.lrd) / any_value(m.lrd) AS score FROM k JOIN l o ON o.i = k.j JOIN l m ON m.i = k.i GROUP BY k.i)
 SELECT i, round(score, 6) + 0.0 AS score, (score > (SELECT quantile_cont(score, 0.99) FROM s))::INTEGER AS label FROM s""",
    "alg1_total_variance": f"""WITH {RAW}, u AS (SELECT i, unnest(v) AS x, unnest(range(0, 64)) AS f FROM e), c AS (SELECT a.f AS f, b.f AS g, covar_pop(a.x, b.x) AS c FROM u a JOIN u b USING (i) GROUP BY 1, 2)
 SELECT round(sum(c) FILTER (WHERE f = g), 6) + 0.0 AS total_variance, round(sum(c * c), 6) + 0.0 AS squared_norm FROM c""",
    "alg6_participation_ratio": f"""WITH {RAW}, u AS (SELECT i, unnest(v) AS x, unnest(range(0, 64)) AS f FROM e), c AS (SELECT a.f AS f, b.f AS g, covar_pop(a.x, b.x) AS c FROM u a JOIN u b USING (i) GROUP BY 1, 2)
 SELECT round(sum(c) FILTER (WHERE f = g) ** 2 / sum(c * c), 6) + 0.0 AS participation_ratio FROM c""",
    "alg5_kernel_rows": f"WITH {RAW}, {Z}, k AS (SELECT a.i, exp(-({L2} * {L2}) / 64) AS k FROM z a, z b) SELECT i, round(min(k), 6) + 0.0 AS low, round(max(k), 6) + 0.0 AS high, round(avg(k), 6) + 0.0 AS mean FROM k GROUP BY i",
    "alg7_two_nn": f"""WITH {RAW}, {Z}, {SELF_Z}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM dd),
 p AS (SELECT i, max(d) FILTER (WHERE n = 1) AS r1, max(d) FILTER (WHERE n = 2) AS r2 FROM k WHERE n <= 2 GROUP BY i)
 SELECT round(1 / avg(ln(r2 / r1)), 6) + 0.0 AS dimension, count(*) AS points FROM p WHERE r1 > 1e-9 * (SELECT max(r2) FROM p)""",
    "alg23_feature_pairs_pearson": f"""WITH {RAW}, u AS (SELECT i, unnest(v) AS x, unnest(range(0, 64))::INTEGER AS f FROM e), c AS (SELECT a.f AS a, b.f AS b, corr(a.x, b.x) AS r FROM u a JOIN u b ON a.i = b.i AND a.f < b.f GROUP BY 1, 2)
 SELECT a, b, round(r, 6) + 0.0 AS r FROM c ORDER BY abs(r) DESC, a, b LIMIT 50""",
    "alg23_feature_pairs_spearman": f"""WITH {RAW}, w AS (SELECT i, unnest(v) AS x, unnest(range(0, 64))::INTEGER AS f FROM e),
 u AS (SELECT i, f, rank() OVER (PARTITION BY f ORDER BY x) + (count(*) OVER (PARTITION BY f, x) - 1) / 2.0 AS x FROM w),
 c AS (SELECT a.f AS a, b.f AS b, corr(a.x, b.x) AS r FROM u a JOIN u b ON a.i = b.i AND a.f < b.f GROUP BY 1, 2) SELECT a, b, round(r, 6) + 0.0 AS r FROM c ORDER BY abs(r) DESC, a, b LIMIT 50""",
    "alg26_property_pearson": """WITH u AS (SELECT unnest([l_quantity, l_discount, l_tax, l_linenumber::DOUBLE]) AS x, unnest([0, 1, 2, 3])::INTEGER AS f, l_extendedprice AS y FROM lineitem)
 SELECT f, round(corr(x, y), 6) + 0.0 AS pearson FROM u GROUP BY f""",
    "alg26_property_spearman": """WITH u AS (SELECT unnest([l_quantity, l_discount, l_tax, l_linenumber::DOUBLE]) AS x, unnest([0, 1, 2, 3])::INTEGER AS f, l_extendedprice AS y FROM lineitem),
 r AS (SELECT f, rank() OVER (PARTITION BY f ORDER BY x) + (count(*) OVER (PARTITION BY f, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY f ORDER BY y) + (count(*) OVER (PARTITION BY f, y) - 1) / 2.0 AS y FROM u)
 SELECT f, round(corr(x, y), 6) + 0.0 AS spearman FROM r GROUP BY f""",
    "alg29_verdicts": """WITH u AS (SELECT unnest([l_quantity, l_discount, l_tax, l_linenumber::DOUBLE]) AS x, unnest([0, 1, 2, 3])::INTEGER AS f, l_extendedprice AS y FROM lineitem)
 SELECT f, CASE WHEN corr(x, y) ** 2 >= 0.8 THEN 'strong' WHEN corr(x, y) ** 2 >= 0.5 THEN 'moderate' ELSE 'weak' END AS encoding FROM u GROUP BY f""",
    "alg30_guarded_correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS usual, 0.0::DOUBLE AS flat FROM lineitem GROUP BY 1",
    "alg31_coverage": f"WITH {SETS}, {COVER} SELECT i, nearest, round(d, 6) + 0.0 AS distance, label FROM lab",
    "alg31_coverage_counts": f"WITH {SETS}, {COVER} SELECT label, count(*) AS n, round(avg(d), 6) + 0.0 AS mean_distance FROM lab GROUP BY label",
    "alg32_overlap": f"""WITH {SETS} SELECT i, nearest, round(d, 6) + 0.0 AS distance, CASE WHEN d <= 1e-8 THEN 0
 WHEN d <= greatest((SELECT quantile_cont(d, 0.05) FROM rd), 1e-8) THEN 1 ELSE 2 END AS label FROM nr""",
    "alg34_uncertainty": f"""WITH {SETS}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM qd)
 SELECT i, max(j) FILTER (WHERE n = 1) AS nearest, round(min(d), 6) + 0.0 AS novelty, round(max(d) + stddev_pop(d), 6) + 0.0 AS uncertainty FROM k WHERE n <= 8 GROUP BY i""",
    "top7_acquisition_pool": f"WITH {SETS} SELECT i, round(d, 6) + 0.0 AS novelty FROM nr ORDER BY d DESC, i LIMIT 100",
    "alg37_drift": f"""WITH {SETS}, b AS (SELECT 0 AS s, * FROM r UNION ALL SELECT 1 AS s, * FROM q), p AS (SELECT a.s AS s, b.s AS t, {L2} AS d FROM b a, b b),
 w AS (SELECT quantile_cont(d, 0.5) AS w FROM p WHERE d > 2.220446049250313e-16), k AS (SELECT s, t, avg(exp(-d * d / (2 * w * w))) AS k FROM p, w GROUP BY s, t),
 u AS (SELECT s, i, unnest(v) AS x, unnest(range(0, 64)) AS f FROM b), m AS (SELECT s, f, avg(x) AS m FROM u GROUP BY s, f),
 c AS (SELECT a.s AS s, a.f AS f, b.f AS g, covar_samp(a.x, b.x) AS c FROM u a JOIN u b ON a.s = b.s AND a.i = b.i GROUP BY 1, 2, 3),
 cs AS (SELECT sqrt(sum((a.c - b.c) ** 2)) / sqrt(sum(a.c ** 2)) AS shift FROM c a JOIN c b ON a.f = b.f AND a.g = b.g AND a.s = 0 AND b.s = 1)
 SELECT round((SELECT sum(CASE WHEN s = t THEN k ELSE -k END) FROM k), 6) + 0.0 AS mmd2, round(w, 6) + 0.0 AS bandwidth,
 round((SELECT sqrt(sum((a.m - b.m) ** 2)) FROM m a JOIN m b ON a.f = b.f AND a.s = 0 AND b.s = 1), 6) + 0.0 AS centroid_distance, round(shift, 6) + 0.0 AS covariance_shift FROM w, cs""",
    "join3_alignment": "SELECT count(*) AS aligned FROM embeddings",
    "alg35_mantel": f"WITH {HALVES}, p AS (SELECT list_distance(a.v, b.v) AS x, list_distance(c.v, d.v) AS y FROM za a JOIN za b ON a.i < b.i JOIN zb c ON c.i = a.i JOIN zb d ON d.i = b.i) "
    "SELECT round(corr(x, y), 6) + 0.0 AS statistic, count(*) AS pairs FROM p",
    "join12_neighbor_overlap": f"""WITH {HALVES}, ka AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY {L2}, b.i) AS n FROM za a, za b WHERE a.i <> b.i),
 kb AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY {L2}, b.i) AS n FROM zb a, zb b WHERE a.i <> b.i)
 SELECT x.i, round(count(y.j) / 10.0, 6) + 0.0 AS overlap FROM (SELECT * FROM ka WHERE n <= 10) x LEFT JOIN (SELECT * FROM kb WHERE n <= 10) y ON x.i = y.i AND x.j = y.j GROUP BY x.i""",
    "alg38_information_imbalance": f"""WITH {HALVES}, ka AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY {L2}, b.i) AS n FROM za a, za b WHERE a.i <> b.i),
 kb AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY {L2}, b.i) AS n FROM zb a, zb b WHERE a.i <> b.i)
 SELECT ka.i, round((kb.n - 1) / ((SELECT count(*) FROM e) - 2), 6) + 0.0 AS contribution FROM ka JOIN kb ON ka.i = kb.i AND ka.j = kb.j WHERE ka.n = 1""",
    "alg36_rand_index": """WITH t AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM t),
 ra AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY b))
 SELECT round((s.s - ra.s * rb.s / (s.n * (s.n - 1) / 2)) / ((ra.s + rb.s) / 2 - ra.s * rb.s / (s.n * (s.n - 1) / 2)), 8) + 0.0 AS ari FROM s, ra, rb""",
    "smp1_random": "SELECT least(100, count(*)) AS n, least(100, count(*)) AS distinct_n FROM embeddings",
    "pre4_composite": f"""WITH {HALVES} SELECT i, unnest(range(0, 64))::INTEGER AS f, round(unnest(list_concat(list_transform(za.v, lambda x: x / sqrt(32)), list_transform(zb.v, lambda x: x * 2 / sqrt(32)))), 6) + 0.0 AS x
 FROM za JOIN zb USING (i)""",
}
SQL["alg38_overlap_curve"] = f"""WITH {HALVES}, ka AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY {L2}, b.i) AS n FROM za a, za b WHERE a.i <> b.i),
 kb AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY {L2}, b.i) AS n FROM zb a, zb b WHERE a.i <> b.i),
 m AS (SELECT greatest(ka.n, kb.n) AS n FROM ka JOIN kb ON ka.i = kb.i AND ka.j = kb.j) SELECT """ + ", ".join(
    f"round(count(*) FILTER (WHERE n <= {k}) / {k}.0 / (SELECT count(*) FROM e), 6) + 0.0 AS overlap_{k}" for k in (1, 2, 4, 8, 16, 32)) + " FROM m"
SQL["smp8_stratified"] = """WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), q AS (SELECT label, 100.0 * n / sum(n) OVER () AS ideal FROM s),
 r AS (SELECT label, floor(ideal) AS base, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, label) AS place, 100 - sum(floor(ideal)) OVER () AS spare FROM q)
 SELECT label, (base + (place <= spare)::INTEGER)::BIGINT AS n FROM r"""
SQL["win6_events_mad"] = f"""WITH {SERIES}, {STEP1}, m AS (SELECT quantile_cont(d, 0.5) AS med FROM ok), t AS (SELECT any_value(med) + 3 * 1.4826 * quantile_cont(abs(d - med), 0.5) AS t FROM ok, m),
 r AS (SELECT *, row_number() OVER (ORDER BY d, i) AS n, count(*) OVER () AS total FROM ok)
 SELECT i, round(d, 6) + 0.0 AS step_distance, round(d / t, 6) + 0.0 AS threshold_ratio, round(n / total, 6) + 0.0 AS percentile FROM r, t WHERE d > t"""
SQL["win7_events_percentile"] = SQL["win6_events_mad"].replace("any_value(med) + 3 * 1.4826 * quantile_cont(abs(d - med), 0.5)", "quantile_cont(d, 0.99)")
SQL["win5_events_zscore"] = SQL["win6_events_mad"].replace("any_value(med) + 3 * 1.4826 * quantile_cont(abs(d - med), 0.5)", "avg(d) + 3 * stddev_pop(d)")
_REACH = f"""{RAW}, {Z}, hit AS (SELECT a.i, b.i AS j FROM z a, z b WHERE {L2} <= 9.7),
 core AS (SELECT i FROM hit GROUP BY i HAVING count(*) >= 5), ce AS (SELECT i, j FROM hit WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
 reach AS (SELECT i, i AS j FROM core UNION SELECT reach.i, ce.j FROM reach JOIN ce ON reach.j = ce.i),
 root AS (SELECT i, min(j) AS root FROM reach GROUP BY i), num AS (SELECT i, (dense_rank() OVER (ORDER BY root) - 1)::INTEGER AS label FROM root),
 lab AS (SELECT e.i, coalesce((SELECT label FROM num WHERE num.i = e.i), (SELECT min(label) FROM hit JOIN num ON num.i = hit.j WHERE hit.i = e.i), -1)::INTEGER AS label FROM e)"""
SQL["alg15_dbscan"] = f"WITH RECURSIVE {_REACH} SELECT i, label FROM lab"
SQL["alg18_cluster_summary"] = f"WITH RECURSIVE {_REACH} SELECT count(DISTINCT label) FILTER (WHERE label >= 0) AS clusters, count(*) FILTER (WHERE label < 0) AS noise, count(*) AS rows FROM lab"
_FPS = f"""WITH RECURSIVE {RAW}, b AS (SELECT i, v, {{start}} AS d FROM e), p AS (
 SELECT 0 AS pick, (SELECT i FROM e ORDER BY i LIMIT 1) AS i, 0.0::DOUBLE AS distance, [(SELECT i FROM e ORDER BY i LIMIT 1)] AS seen
 UNION ALL SELECT p.pick + 1, n.i, n.d, list_append(p.seen, n.i) FROM p, LATERAL (
   SELECT c.i, min(list_distance(c.v, s.v)) AS d FROM e c, e s WHERE list_contains(p.seen, s.i) AND NOT list_contains(p.seen, c.i)
   GROUP BY c.i ORDER BY d DESC, c.i LIMIT 1) n WHERE p.pick < 24)
 SELECT pick, i, round(distance, 6) + 0.0 AS distance FROM p"""
SQL["smp2_fps_raw"] = _FPS.format(start="0")
SQL |= {f"{name}_large": SQL[name] for name in LARGE}
SQL["alg26_mutual_information"] = f"""WITH {RAW}, t AS (SELECT i, list_sum(v) AS y FROM e), w AS (SELECT i, unnest(v) AS x, unnest(range(0, 64))::INTEGER AS f FROM e),
 m AS (SELECT f, stddev_pop(x) AS s FROM w GROUP BY f), u AS (SELECT i, f, x / s AS x, y / (SELECT stddev_pop(y) FROM t) AS y FROM w JOIN m USING (f) JOIN t USING (i)),
 p AS (SELECT a.f, a.i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM u a JOIN u b ON a.f = b.f AND a.i <> b.i),
 r AS (SELECT f, i, max(g) AS r FROM (SELECT f, i, greatest(dx, dy) AS g, row_number() OVER (PARTITION BY f, i ORDER BY greatest(dx, dy)) AS n FROM p) WHERE n <= 3 GROUP BY f, i),
 c AS (SELECT f, i, 1 + count(*) FILTER (WHERE dx < r) AS nx, 1 + count(*) FILTER (WHERE dy < r) AS ny FROM p JOIN r USING (f, i) GROUP BY f, i),
 h AS (SELECT m, coalesce(sum(1.0::DOUBLE / (m - 1)) FILTER (WHERE m > 1) OVER (ORDER BY m), 0) - 0.5772156649015329 AS psi FROM range(1, (SELECT count(*) + 1 FROM e)) g(m))
 SELECT f, round(greatest(0, (SELECT psi FROM h WHERE m = (SELECT count(*) FROM e)) + (SELECT psi FROM h WHERE m = 3) - avg(a.psi + b.psi)), 6) + 0.0 AS mutual_information
 FROM c JOIN h a ON a.m = nx JOIN h b ON b.m = ny GROUP BY f"""
