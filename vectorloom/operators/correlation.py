"""Feature-feature and feature-property correlation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import insufficient, invalid
from ..functions.vec import finite, unpivot
from ..params import choice, float_param, int_param, seed_param
from . import preprocess
from .neighbors import nearest
from .ordering import average_ranks, exact_quantiles, quantile_values


def guarded(x: str | Column, y: str | Column) -> Column:
    """Correlation aggregate where a side without spread gives zero, and two equal constants one."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    same = (F.stddev_pop(x) == 0) & (F.stddev_pop(y) == 0) & (F.max(F.abs(x - y)) == 0)
    return F.when(spread > 0, F.covar_pop(x, y) / spread).when(same, F.lit(1.0)).otherwise(F.lit(0.0))


def rank_vectors(df: DataFrame) -> DataFrame:
    """Every feature replaced by its average rank."""
    ranked = average_ranks(unpivot(df, "i"), ["f"], "x")
    packed = F.array_sort(F.collect_list(F.struct("f", "rank")))
    return ranked.groupBy("i").agg(F.transform(packed, lambda s: s["rank"]).alias("features"))


def feature_correlation(df: DataFrame, params: dict | None = None) -> dict:
    """Correlation matrix of the (at most ``heatmap_features``) widest features.

    The d x d matrix is one distributed aggregate; choosing pairs out of it is
    work on a table whose size the heatmap bound fixes.
    """
    params = params or {}
    method = choice(params, "method", "pearson", ("pearson", "spearman"))
    floor = float_param(params, "variance_threshold", 0.0, 0.0)
    n, mean, std = preprocess.feature_moments(df)
    if n < 2:
        raise insufficient(2, n)
    valid = preprocess.meaningful(mean, std) & (std * std > floor)
    if valid.sum() < 2:
        raise insufficient(2, int(valid.sum()))
    limit = len(valid) if params.get("heatmap_features") is None else int_param(params, "heatmap_features", 256, 2)
    order = np.argsort(-(std * std), kind="stable")
    wide = int(valid.sum()) > limit
    chosen = np.array([f for f in order if valid[f]][:limit]) if wide else np.flatnonzero(valid)
    source = df
    if method == "spearman":
        source = rank_vectors(df.select("i", F.transform(
            F.array(*[F.lit(int(f)) for f in chosen]), lambda f: F.get(F.col("features"), f)).alias("features")))
        picked = F.col("features")
    else:
        picked = F.transform(F.array(*[F.lit(int(f)) for f in chosen]), lambda f: F.get(F.col("features"), f))
        picked = F.zip_with(picked, F.array(*[F.lit(float(mean[f])) for f in chosen]), lambda x, m: x - m)
    full = Correlation.corr(source.select(array_to_vector(picked).alias("v")), "v").head()[0].toArray()
    return {"features": chosen, "matrix": full, "zero_variance": int((~valid).sum()), "limited": wide, "width": len(mean)}


def top_pairs(found: dict, k: int = 50) -> list[tuple[int, int, float]]:
    """Strongest pairs by absolute value, ties in matrix order."""
    a, b = np.triu_indices(len(found["features"]), 1)
    values = found["matrix"][a, b]
    best = np.argsort(-np.abs(values), kind="stable")[:k]
    return [(int(found["features"][a[p]]), int(found["features"][b[p]]), float(values[p])) for p in best]


def redundancy(found: dict, threshold: float = 0.95) -> dict:
    """Pairs at or above the threshold and the groups they form."""
    strong = np.argwhere(np.triu(np.abs(found["matrix"]) >= threshold, 1))
    group = {}
    for a, b in strong.tolist():
        merged = group.get(a, {a}) | group.get(b, {b})
        for member in merged:
            group[member] = merged
    return {
        "pairs": len(strong),
        "groups": len({id(g) for g in group.values()}),
        "features": sorted(int(found["features"][m]) for m in group),
    }


def linkage_tree(gap: np.ndarray) -> list[tuple[int, int]]:
    """Average-linkage merges; node ``size + k`` joins the two nodes of entry ``k``.

    Of equally near pairs the first in row order is joined.
    """
    size = len(gap)
    gap = gap.astype(float).copy()
    np.fill_diagonal(gap, np.inf)
    node, weight, merges = list(range(size)), np.ones(size), []
    for k in range(size - 1):
        a, b = sorted(divmod(int(gap.argmin()), size))
        merges.append((node[a], node[b]))
        blended = (gap[a] * weight[a] + gap[b] * weight[b]) / (weight[a] + weight[b])
        gap[a, :] = gap[:, a] = blended
        gap[a, a] = np.inf
        gap[b, :] = gap[:, b] = np.inf
        weight[a] += weight[b]
        node[a] = size + k
    return merges


def optimal_leaves(merges: list[tuple[int, int]], apart: np.ndarray) -> list[int]:
    """The leaves in the order that turns subtrees so that steps between neighbours sum to the least.

    ``cost[u, w]`` is the least sum of an order of the smallest subtree holding
    both that begins with ``u`` and ends with ``w``; a pair has one such
    subtree, so one matrix holds them all.  The end with the smaller number
    comes first.
    """
    size = len(apart)
    if size < 2:
        return list(range(size))
    leaves: list[np.ndarray] = [np.array([k]) for k in range(size)]
    cost = np.zeros((size, size))

    def ends(node: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Which leaves can begin and which end an order of the subtree."""
        if node < size:
            return [(leaves[node], leaves[node])]
        left, right = (leaves[part] for part in merges[node - size])
        return [(left, right), (right, left)]

    for left, right in merges:
        for first, inner in ends(left):
            reached = np.full((len(first), len(leaves[right])), np.inf)
            for m in inner:
                reached = np.minimum(reached, cost[first, m][:, None] + apart[m, leaves[right]][None, :])
            place = {int(k): p for p, k in enumerate(leaves[right])}
            for last, begun in ends(right):
                best = np.full((len(first), len(last)), np.inf)
                for k in begun:
                    best = np.minimum(best, reached[:, [place[int(k)]]] + cost[k, last][None, :])
                cost[np.ix_(first, last)] = best
                cost[np.ix_(last, first)] = best.T
        leaves.append(np.concatenate([leaves[left], leaves[right]]))

    top_left, top_right = (leaves[part] for part in merges[-1])
    u, w = np.unravel_index(int(cost[np.ix_(top_left, top_right)].argmin()), (len(top_left), len(top_right)))
    order: list[int] = []
    waiting = [(len(leaves) - 1, *sorted((int(top_left[u]), int(top_right[w]))))]
    while waiting:
        node, first, last = waiting.pop()
        if node < size:
            order.append(node)
            continue
        left, right = merges[node - size]
        if first not in leaves[left]:
            left, right = right, left
        inner = next(i for f, i in ends(left) if first in f)
        begun = next(f for f, i in ends(right) if last in i)
        total = cost[first, inner][:, None] + apart[np.ix_(inner, begun)] + cost[begun, last][None, :]
        m, k = np.unravel_index(int(total.argmin()), total.shape)
        waiting += [(right, int(begun[k]), last), (left, first, int(inner[m]))]
    return order


def clustered_order(found: dict) -> list[int]:
    """Features ordered so that alike ones stand together.

    Average linkage over ``1 - |r|`` with the best order of its leaves; the
    table is as large as the features compared.
    """
    gap = 1.0 - np.minimum(np.abs(found["matrix"]), 1.0)
    return [int(found["features"][k]) for k in optimal_leaves(linkage_tree(gap), gap)]


# --- property correlation ----------------------------------------------------


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a finite target, as ``i, features, y``."""
    return df.select("i", "features", finite(F.col(target)).alias("y")).where(F.col("y").isNotNull())


def property_pearson(rows: DataFrame) -> DataFrame:
    return unpivot(rows, "y").groupBy("f").agg(guarded("x", "y").alias("pearson"))


def property_spearman(rows: DataFrame) -> DataFrame:
    ranked_y = average_ranks(rows.select("i", "y"), [], "y", "ry").select("i", "ry")
    ranked_x = average_ranks(unpivot(rows, "i"), ["f"], "x", "rx")
    return ranked_x.join(ranked_y, "i").groupBy("f").agg(guarded("rx", "ry").alias("spearman"))


def cross_validated(df: DataFrame, target: str, params: dict | None = None) -> DataFrame:
    """Out-of-fold ridge predictions and distances to the training rows.

    Columns ``i, y, fold, prediction, baseline, distance``.  Folds come from a
    hash of the id; each fold is one distributed normal-equation solve and one
    nearest-neighbour search.
    """
    params = params or {}
    folds = int_param(params, "folds", 5, 2)
    alpha = float_param(params, "alpha", 1.0, 0.0)
    k = int_param(params, "reliability_k", 5)
    metric = choice(params, "distance_metric", "euclidean", ("euclidean", "cosine"))
    rows = with_target(df, target)
    n, mean, std = preprocess.feature_moments(rows)
    if n < 3:
        raise insufficient(3, n)
    keep = [int(f) for f in np.flatnonzero(preprocess.meaningful(mean, std))]
    if not keep:
        raise invalid("analysis requires at least one informative feature")
    folds = min(folds, n)
    fold = F.pmod(F.xxhash64("i", F.lit(seed_param(params))), F.lit(folds)).cast("int")
    picked = F.transform(F.array(*[F.lit(f) for f in keep]), lambda f: F.get(F.col("features"), f))
    rows = rows.select("i", "y", picked.alias("features"), fold.alias("fold"))
    parts = []
    for number in range(folds):
        train, test = rows.where(F.col("fold") != number), rows.where(F.col("fold") == number)
        scaler = preprocess.fit_reference(train)
        train, test = scaler.apply(train), scaler.apply(test)
        level, spread = train.agg(F.avg("y"), F.stddev_pop("y")).first()
        # The solver divides its penalty by the target's spread.
        model = LinearRegression(
            featuresCol="v", labelCol="y", predictionCol="prediction", regParam=alpha / scaler.rows * spread,
            elasticNetParam=0.0, standardization=False, solver="normal",
        ).fit(train.select(array_to_vector("features").alias("v"), "y"))
        guessed = model.transform(test.withColumn("v", array_to_vector("features"))).select(
            "i", "y", "fold", "prediction", F.lit(level).alias("baseline"))
        far = nearest(train, test, min(k, scaler.rows), metric).select(
            "i", (F.aggregate("distances", F.lit(0.0), lambda a, d: a + d) / F.size("distances")).alias("distance"))
        parts.append(guessed.join(far, "i"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scores(held_out: DataFrame) -> dict:
    """R2, RMSE and MAE of the model and of the fold means."""
    spread = held_out.agg(F.var_pop("y")).first()[0]
    row = held_out.agg(
        F.avg((F.col("prediction") - F.col("y")) ** 2).alias("mse"), F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("mae"),
        F.avg((F.col("baseline") - F.col("y")) ** 2).alias("base_mse"), F.avg(F.abs(F.col("baseline") - F.col("y"))).alias("base_mae"),
    ).first()
    return {
        "r2": 1 - row["mse"] / spread, "rmse": row["mse"] ** 0.5, "mae": row["mae"],
        "baseline_r2": 1 - row["base_mse"] / spread, "baseline_rmse": row["base_mse"] ** 0.5, "baseline_mae": row["base_mae"],
    }


def reliability(held_out: DataFrame, params: dict | None = None) -> dict:
    """How errors grow with distance from the training rows."""
    params = params or {}
    sparse = float_param(params, "sparse_quantile", 0.90, 0.5, 0.99)
    far = float_param(params, "ood_quantile", 0.99, sparse, 0.999)
    rows = held_out.select("i", "distance", F.abs(F.col("prediction") - F.col("y")).alias("error"))
    n = rows.count()
    bins = min(12, max(4, int(n**0.5)))
    edges = sorted(set(quantile_values(rows, "distance", [k / bins for k in range(bins + 1)])))
    sparse_at, far_at = quantile_values(rows, "distance", [sparse, far])
    high_error = quantile_values(rows, "error", [0.90])[0]
    slot = F.lit(0)
    for edge in edges[1:-1]:
        slot = slot + (F.col("distance") >= F.lit(edge)).cast("int")
    binned = rows.withColumn("bin", slot)
    centre = exact_quantiles(binned, ["bin"], "distance", [0.5], ["centre"])
    spread = exact_quantiles(binned, ["bin"], "error", [0.5, 0.9, 0.95], ["median", "p90", "p95"])
    counts = rows.agg(
        F.count_if(F.col("distance") > sparse_at).alias("sparse"), F.count_if(F.col("distance") > far_at).alias("ood"),
        F.count_if((F.col("distance") > sparse_at) & (F.col("error") > high_error)).alias("sparse_high_error"),
        guarded("distance", "error").alias("pearson"),
    ).first()
    return {"bins": centre.join(spread, "bin"), "sparse_threshold": sparse_at, "ood_threshold": far_at,
            "high_error_threshold": high_error, **counts.asDict()}


def distance_versus_property(df: DataFrame, target: str, params: dict | None = None) -> DataFrame:
    """Pairs drawn by hash: vector distance against property difference.

    A sampling operator with a fixed number of draws; partners meet through an
    equi-join on the drawn position, so no pair outside the draw is formed.
    """
    from ..functions.vec import euclidean
    from .ordering import positions

    params = params or {}
    draws = int_param(params, "pair_samples", 20_000, 100)
    seed = seed_param(params)
    rows = with_target(df, target)
    rows = preprocess.fit(rows).apply(rows)
    placed = positions(rows, "i", "pos").select("pos", "features", "y")
    n = placed.count()
    if n <= 250:
        wanted = df.sparkSession.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id"), F.lit(n - 1))).alias("b"))
    else:
        wanted = df.sparkSession.range(draws).select(
            F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("a"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n)).alias("b"))
    wanted = wanted.where("a <> b")
    left = placed.select(F.col("pos").alias("a"), F.col("features").alias("u"), F.col("y").alias("ya"))
    right = placed.select(F.col("pos").alias("b"), F.col("features").alias("w"), F.col("y").alias("yb"))
    return wanted.join(left, "a").join(right, "b").select(
        "a", "b", euclidean(F.col("u"), F.col("w")).alias("distance"), F.abs(F.col("ya") - F.col("yb")).alias("delta"))


# Verdict limits.
STRONG_R2, MODERATE_R2 = 0.8, 0.5


def verdict(r2: float, best_pearson: float) -> tuple[str, str]:
    """How strongly a property is encoded, and whether single features carry it."""
    strength = "strong" if r2 >= STRONG_R2 else "moderate" if r2 >= MODERATE_R2 else "weak"
    if r2 >= STRONG_R2:
        return strength, "dominant_features" if best_pearson >= 0.6 else "distributed"
    return strength, "insufficient" if r2 < MODERATE_R2 and best_pearson < 0.4 else "mixed"

