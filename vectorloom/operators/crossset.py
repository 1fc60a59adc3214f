"""Two vector sets compared: coverage, overlap, drift, acquisition, alignment."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import held_rows, ints, matrix, shipped_slices, small_matrix, table_batches, vectors
from ..errors import LoomError, RESULT_INCOMPATIBLE, insufficient, invalid
from ..params import choice, float_param, int_param, seed_param
from ..session import cut_lineage
from . import preprocess
from .neighbors import (
    CHUNK_ROWS, METRICS, TASK_PAIRS, _gaps, _squared_screen, broadcast_reduce, held_places, listed, nearest, pair_distances, places_of,
    screened_tiles, self_nearest,
)
from .ordering import quantile_values
from .spectrum import bounded_rows, effective_dimension, second_moments, visual_plane


@dataclass(frozen=True)
class Pair:
    """Both sets on the reference's scale."""

    reference: DataFrame
    query: DataFrame
    reference_rows: int
    metric: str
    warnings: tuple[str, ...] = ()


def scaled_pair(reference: DataFrame, query: DataFrame, params: dict) -> Pair:
    scaler = preprocess.fit_reference(reference, choice(params, "preprocess", "standardized", preprocess.MODES))
    return Pair(
        scaler.apply(reference).select("i", "features"), scaler.apply(query).select("i", "features"), scaler.rows,
        choice(params, "metric", "euclidean", METRICS), scaler.warnings)


def nearest_reference(pair: Pair) -> DataFrame:
    return nearest(pair.reference, pair.query, 1, pair.metric).select(
        "i", F.col("indices")[0].alias("nearest"), F.col("distances")[0].alias("distance"))


def self_distance_quantiles(pair: Pair, shares: list[float]) -> list[float]:
    """Quantiles of each reference row's distance to its nearest other."""
    if pair.reference_rows < 2:
        return [0.0] * len(shares)
    own = self_nearest(pair.reference, 1, pair.metric).select(F.col("distances")[0].alias("d"))
    return quantile_values(own, "d", shares, pair.reference_rows)


def _three_way(found: DataFrame, first: float, second: float) -> DataFrame:
    return found.withColumn(
        "label", F.when(F.col("distance") <= first, 0).when(F.col("distance") <= second, 1).otherwise(2))


def coverage(reference: DataFrame, query: DataFrame, params: dict | None = None) -> dict:
    """Each query row: covered, marginal or outside, by the reference's own spacing."""
    params = params or {}
    pair = scaled_pair(reference, query, params)
    if params.get("q95") is None or params.get("q99") is None:
        default95, default99 = self_distance_quantiles(pair, [0.95, 0.99])
    else:
        default95 = default99 = 0.0
    q95 = float_param(params, "q95", default95, 0.0)
    q99 = float_param(params, "q99", default99, 0.0)
    if q99 < q95:
        raise invalid("q99 must be >= q95")
    return {"table": _three_way(nearest_reference(pair), q95, q99), "q95": q95, "q99": q99, "pair": pair}


def overlap(reference: DataFrame, query: DataFrame, params: dict | None = None) -> dict:
    """Near duplicates, highly similar rows, and the rest."""
    params = params or {}
    pair = scaled_pair(reference, query, params)
    same = float_param(params, "duplicate_threshold", 1e-8, 0.0)
    default = same if params.get("similar_threshold") is not None else self_distance_quantiles(pair, [0.05])[0]
    close = float_param(params, "similar_threshold", max(default, same), same)
    return {"table": _three_way(nearest_reference(pair), same, close), "duplicate": same, "similar": close}


def label_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))


# --- acquisition -------------------------------------------------------------


def acquisition_scores(reference: DataFrame, query: DataFrame, params: dict | None = None) -> tuple[DataFrame, Pair]:
    """``i, nearest, novelty, uncertainty`` for every query row."""
    params = params or {}
    pair = scaled_pair(reference, query, params)
    method = choice(params, "acquisition_method", "novelty_fps", ("novelty_fps", "uncertainty_diversity"))
    if method == "novelty_fps":
        found = nearest_reference(pair)
        return found.select("i", "nearest", F.col("distance").alias("novelty"), F.col("distance").alias("uncertainty")), pair
    k = min(int_param(params, "uncertainty_k", 8, 2), pair.reference_rows)
    found = nearest(pair.reference, pair.query, k, pair.metric)
    mean = F.aggregate("distances", F.lit(0.0), lambda a, d: a + d) / F.size("distances")
    spread = F.sqrt(F.aggregate("distances", F.lit(0.0), lambda a, d: a + (d - mean) * (d - mean)) / F.size("distances"))
    return found.select(
        "i", F.col("indices")[0].alias("nearest"), F.col("distances")[0].alias("novelty"),
        (F.element_at("distances", -1) + spread).alias("uncertainty")), pair


def acquisition_pool(scored: DataFrame, target: int, factor: float, rows: int) -> DataFrame:
    """The highest-scoring rows the greedy choice looks at: a top-k, not a cut of results."""
    size = min(rows, max(target, int(round(target * factor))))
    return scored.orderBy(F.desc("uncertainty"), "i").limit(size)


def acquire(reference: DataFrame, query: DataFrame, params: dict | None = None) -> list[tuple[int, float]]:
    """Greedy batch balancing base score and spread: ``(i, pick score)`` in pick order."""
    params = params or {}
    scored, pair = acquisition_scores(reference, query, params)
    rows = query.count()
    target = min(int_param(params, "n_samples", 100), rows)
    pool = acquisition_pool(scored, target, float_param(params, "pool_factor", 5.0, 1.0), rows)
    uncertain = choice(params, "acquisition_method", "novelty_fps", ("novelty_fps", "uncertainty_diversity")) != "novelty_fps"
    weight = float_param(params, "uncertainty_weight" if uncertain else "novelty_weight", 0.65, 0.0, 1.0)
    rows = pool.select("i", F.col("uncertainty").alias("base")).join(pair.query, "i").toArrow().sort_by([("base", "descending"), ("i", "ascending")])
    ids, points = ints(rows.column("i").combine_chunks()), matrix(rows.column("features"))
    base = ints(rows.column("base").combine_chunks())
    merit = (base - base.min()) / max(float(np.ptp(base)), 1e-15)
    return [(int(ids[p]), score) for p, score in itertools.islice(_spread_picks(merit, points, weight, pair.metric), target)]


def _spread_picks(merit: np.ndarray, points: np.ndarray, weight: float, metric: str) -> Iterator[tuple[int, float]]:
    """Places and scores in pick order: the best merit first, then a blend of merit and room.

    Room is the distance to the nearest earlier pick, as a share of the largest
    distance from the first one.
    """
    left = np.arange(len(merit))
    picked = int(merit.argmax())
    yield picked, float(merit[picked])
    room = pair_distances(points, points[[picked]], metric)[:, 0]
    scale = max(float(room.max()), 1e-15)
    while len(left := left[left != picked]):
        blend = weight * merit[left] + (1 - weight) * room[left] / scale
        best = int(blend.argmax())
        picked = int(left[best])
        yield picked, float(blend[best])
        room = np.minimum(room, pair_distances(points, points[[picked]], metric)[:, 0])


# --- drift -------------------------------------------------------------------


def _sampled_pair(pair: Pair, limit: int | None) -> DataFrame:
    """Rows of both sets with a source flag, evenly spread ones where a limit is asked for."""
    a = bounded_rows(pair.reference, limit).select("i", "features", F.lit(0).cast("bigint").alias("tag"))
    b = bounded_rows(pair.query, limit).select("i", "features", F.lit(1).cast("bigint").alias("tag"))
    return a.unionByName(b)


def _numbered(both: DataFrame) -> DataFrame:
    """Rows with a number of their own, dealt so that tasks of pairs are many and even."""
    rows, context = both.count(), both.sparkSession.sparkContext
    if rows >= CHUNK_ROWS:
        both = both.repartition(max(4 * context.defaultParallelism, -(-rows * rows // TASK_PAIRS)))
    return cut_lineage(both.withColumn("i", F.monotonically_increasing_id()))


def _later_tiles(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Tiles of squared distances to rows with a higher id, infinite for others: each pair of a set comes once.

    ``rows, columns, squares, slack``; most tiles of lower ids are not made at all.
    Ids of both sides ascend.
    """
    if not len(q) or not len(r):
        return
    first = int(np.searchsorted(r_ids, q_ids[0], "right"))
    if first == len(r):
        return
    for start, columns, square, slack in screened_tiles(q, r[first:]):
        rows, columns = slice(start, start + len(square)), slice(columns.start + first, columns.stop + first)
        if r_ids[columns.start] <= q_ids[rows][-1]:
            np.copyto(square, np.inf, where=r_ids[None, columns] <= q_ids[rows, None])
        yield rows, columns, square, slack


def _ascending(ids: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    if (ids[1:] >= ids[:-1]).all():
        return ids, *columns
    order = np.argsort(ids, kind="stable")
    return tuple(c[order] for c in (ids, *columns))


# Rows whose distances tell where the middle one may lie, and its likely share of them on either side.
WINDOW_ROWS, WINDOW_SHARE = 1024, 0.05


def _distance_median(both: DataFrame, slots: int = 1 << 16) -> float:
    """Median positive distance between all rows of both sets, whose ids are unique.

    Tasks count squared distances into slots of a window that a few rows suggest;
    only those around the slots that hold the middle ranks are then listed, and
    all below are counted.  Where the middle lies outside the window all of the
    range is the next one.  No list of all pairs is ever formed.
    """
    eps = np.finfo(float).eps
    drawn = matrix(both.orderBy(F.xxhash64("i"), "i").limit(WINDOW_ROWS).select("features").toArrow().column("features"))
    some = pair_distances(drawn, drawn, "euclidean")
    some = some[some > eps]
    reach = both.agg(F.max(F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    # Room for the rounding of the squares.
    margin = 1e-9 * max(reach * reach, 1e-300)
    whole = (0.0, 4.0 * reach * reach + margin)
    near = tuple(np.quantile(some, [0.5 - WINDOW_SHARE, 0.5 + WINDOW_SHARE]) ** 2) if len(some) else whole
    rows = both.count()
    for low, high in (near, whole):
        low, high = low - margin, high + margin
        found = _median_slots(both, low, high, slots)
        zeros = found.pop(-2, 0)
        total = rows * (rows - 1) // 2 - zeros
        if not total:
            return 1.0
        ranks = [(total - 1) // 2, total // 2]
        below = found.pop(-1, 0) - zeros
        names = np.array(sorted(found), dtype=np.int64)
        upto = below + np.cumsum([found[k] for k in names.tolist()])
        # Ranks at the window's ends could be misplaced by rounding.
        if len(names) and (low <= 0 or ranks[0] >= below) and ranks[1] < upto[-1]:
            spots = np.searchsorted(upto, ranks, side="right")
            width = (high - low) / slots
            bottom = low + names[spots[0]] * width - 2 * margin
            top = low + (names[spots[1]] + 1) * width + 2 * margin
            listed_, before = _listed_distances(both, bottom, top)
            before = before - zeros if bottom > 0 else 0
            cumulative = before + np.cumsum([n for _d, n in listed_])
            if before <= ranks[0] and len(cumulative) and ranks[1] < cumulative[-1]:
                middle = [listed_[int(np.searchsorted(cumulative, r, side="right"))][0] for r in ranks]
                return float((middle[0] + middle[1]) / 2)
    raise LoomError(RESULT_INCOMPATIBLE, "no middle distance; vectors must be finite")


def _median_slots(both: DataFrame, low: float, high: float, slots: int) -> dict[int, int]:
    """Pairs by slot of their squared distance; -1 has all below the window, -2 those at zero."""
    eps, scale = np.finfo(float).eps, slots / (high - low)

    def count(q_ids, q, _qt, r_ids, r, _rt):
        q_ids, q = _ascending(q_ids, q)
        r_ids, r = _ascending(r_ids, r)
        held, below, zeros = np.zeros(slots, dtype=np.int64), 0, 0
        for rows, columns, square, slack in _later_tiles(q_ids, q, r_ids, r):
            if square.min() <= 2 * slack.max():
                at, to = listed(square <= 2 * slack[:, None])
                zeros += int((_gaps(q[rows], at, r[columns], to) <= eps).sum())
            below += np.count_nonzero(square < low)
            inside = square[(square >= low) & (square < high)]
            inside -= low
            inside *= scale
            held += np.bincount(np.minimum(inside.astype(np.int64), slots - 1), minlength=slots)
        slot = np.flatnonzero(held)
        return np.concatenate([[-2, -1], slot]), np.concatenate([[zeros, below], held[slot]])

    found = broadcast_reduce(
        both, both, count, "slot bigint, n bigint", lambda parts: parts.groupBy("slot").agg(F.sum("n").alias("n")), CHUNK_ROWS)
    return {r["slot"]: r["n"] for r in found.collect() if r["n"]}


def _listed_distances(both: DataFrame, bottom: float, top: float) -> tuple[list[tuple[float, int]], int]:
    """Distances whose squares lie between the two, with their number, and how many pairs are below."""
    eps = np.finfo(float).eps
    least, most = np.sqrt(max(bottom, 0.0)), np.sqrt(max(top, 0.0))

    def listing(q_ids, q, _qt, r_ids, r, _rt):
        q_ids, q = _ascending(q_ids, q)
        r_ids, r = _ascending(r_ids, r)
        below, kept = 0, [np.zeros(0)]
        for rows, columns, square, slack in _later_tiles(q_ids, q, r_ids, r):
            close = (bottom - 2 * slack)[:, None]
            below += np.count_nonzero(square < close)
            at, to = listed((square >= close) & (square <= (top + 2 * slack)[:, None]))
            if len(at):
                d = _gaps(q[rows], at, r[columns], to)
                below += np.count_nonzero(d < least)
                kept.append(d[(d >= least) & (d <= most) & (d > eps)])
        values, n = np.unique(np.concatenate(kept), return_counts=True)
        return np.append(values, -1.0), np.append(n, below)

    found = broadcast_reduce(
        both, both, listing, "d double, n bigint", lambda parts: parts.groupBy("d").agg(F.sum("n").alias("n")), CHUNK_ROWS).orderBy("d").toArrow()
    pairs = list(zip(found.column("d").to_pylist(), found.column("n").to_pylist()))
    return [p for p in pairs if p[0] >= 0], sum(n for d, n in pairs if d < 0)


def drift(reference: DataFrame, query: DataFrame, params: dict | None = None) -> dict:
    """Coverage plus distribution shift.

    All rows count unless ``distribution_samples`` asks for an evenly spread
    subset of each side.
    """
    params = dict(params or {})
    covered = coverage(reference, query, params)
    pair = covered["pair"]
    limit = None if params.get("distribution_samples") is None else int_param(params, "distribution_samples", 500, 20)
    both = _numbered(_sampled_pair(pair, limit)).persist()
    try:
        width = params.get("bandwidth")
        width = _distance_median(both) if width is None else float_param(params, "bandwidth", 1.0, 2.220446049250313e-16)
        gamma = 1.0 / (2.0 * width * width)

        def mass(q_ids, q, q_tag, r_ids, r, r_tag):
            q_ids, q, q_tag = _ascending(q_ids, q, q_tag)
            r_ids, r, r_tag = _ascending(r_ids, r, r_tag)
            sides = np.column_stack([r_tag == 0, r_tag == 1]).astype(float)
            sums = np.zeros((2, 2))
            for rows, columns, square, _slack in _later_tiles(q_ids, q, r_ids, r):
                # Rounding of the product moves a term by no more than a few ulps of the squared norms.
                np.maximum(square, 0.0, out=square)
                square *= -gamma
                part = np.exp(square, out=square) @ sides[columns]
                for source in (0, 1):
                    sums[source] += part[q_tag[rows] == source].sum(axis=0)
            return np.arange(2), sums[:, 0], sums[:, 1]

        sums = broadcast_reduce(
            both, both, mass, "source bigint, to_a double, to_b double",
            lambda parts: parts.groupBy("source").agg(F.sum("to_a").alias("a"), F.sum("to_b").alias("b")), CHUNK_ROWS).collect()
        by = {r["source"]: r for r in sums}
        sizes = {r["tag"]: r["n"] for r in both.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()}
        n, m = sizes[0], sizes[1]
        # Each pair came once; a row is at one to itself.
        mmd = (n + 2 * by[0]["a"]) / n**2 + (m + 2 * by[1]["b"]) / m**2 - 2 * (by[0]["b"] + by[1]["a"]) / (n * m)
        left, right = (second_moments(both.where(F.col("tag") == t).select("i", "features")) for t in (0, 1))
        shift = None
        if n > 1 and m > 1:
            ca, cb = left.covariance * n / (n - 1), right.covariance * m / (m - 1)
            shift = float(np.linalg.norm(ca - cb) / max(np.linalg.norm(ca), 1e-15))
    finally:
        both.unpersist()
    return {
        **covered, "mmd2": max(float(mmd), 0.0), "bandwidth": width,
        "centroid_distance": float(np.linalg.norm(left.mean - right.mean)), "covariance_shift": shift,
        "mmd_reference_rows": n, "mmd_query_rows": m,
    }


# --- aligned spaces ----------------------------------------------------------


def require_aligned(left: DataFrame, right: DataFrame) -> int:
    """Both spaces must describe the same ids; returns how many."""
    both = left.select("i", F.lit(1).alias("l")).join(right.select("i", F.lit(1).alias("r")), "i", "full_outer")
    row = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l").isNull() | F.col("r").isNull()).alias("lonely")).first()
    if row["lonely"]:
        raise LoomError(RESULT_INCOMPATIBLE, "comparison requires aligned sample ids", unmatched=row["lonely"])
    return row["n"]


def _aligned(left: DataFrame, right: DataFrame, params: dict, limit: int | None, minimum: int) -> tuple[DataFrame, DataFrame, int]:
    n = require_aligned(left, right)
    if n < minimum:
        raise insufficient(minimum, n)
    mode = choice(params, "preprocess", "standardized", preprocess.MODES)
    sides = []
    for side in (left, right):
        sides.append(bounded_rows(preprocess.fit(side, mode).apply(side).select("i", "features"), limit, n))
    return sides[0], sides[1], n if limit is None else min(n, limit)


def _distance_grid(points: DataFrame, metric: str, limit: int) -> np.ndarray:
    """Distance matrix of a bounded sample, rows computed in tasks."""
    ids, values = small_matrix(points, "aligned sample", limit)
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_batches(batches, 256):
            mine = ints(batch.column("id"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), vectors(pair_distances(shared.value[mine], shared.value, metric))], names=["id", "d"])

    rows = spark.range(len(ids)).mapInArrow(run, "id bigint, d array<double>").toArrow().sort_by("id")
    return matrix(rows.column("d"))


def _ranks(values: np.ndarray) -> np.ndarray:
    _u, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2.0)[place]


def _pearson(a: np.ndarray, b: np.ndarray) -> float:
    """Zero where undefined, one for two equal constants."""
    if len(a) != len(b) or len(a) < 2:
        return 0.0
    if not preprocess.meaningful(np.array([a.mean(), b.mean()]), np.array([a.std(), b.std()])).all():
        return 1.0 if np.allclose(a, b) else 0.0
    return float(np.corrcoef(a, b)[0, 1])


def _grid_sums(a: DataFrame, b: DataFrame, metric: str, limit: int, permutations: int, seed: int) -> tuple[float, int, DataFrame]:
    """Observed rank correlation, pairs and the null's, from distance grids of a bounded sample."""
    fixed, grid = _distance_grid(a, metric, limit), _distance_grid(b, metric, limit)
    upper = np.triu_indices(len(grid), 1)
    # Relabelling rows only moves distances about, so their ranks are taken once.
    fixed = _ranks(fixed[upper])
    ranked = np.zeros_like(grid)
    ranked[upper] = _ranks(grid[upper])
    grid = ranked + ranked.T
    moved = grid[upper]
    observed = _pearson(fixed, moved)
    spread = fixed.std() * moved.std() * len(fixed)
    centred = np.zeros_like(grid)
    centred[upper] = fixed - fixed.mean()
    spark = a.sparkSession
    shared = spark.sparkContext.broadcast((centred, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, distances = shared.value
        for batch in batches:
            out = []
            for p in ints(batch.column("id")):
                order = np.random.default_rng([seed, int(p)]).permutation(len(distances))
                out.append(float((weights * distances[np.ix_(order, order)]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.float64())], names=["id", "covered"])

    null = spark.range(permutations).mapInArrow(run, "id bigint, covered double").select(
        "id", (F.col("covered") / F.lit(spread if spread > 0 else 1.0)).alias("r"))
    return observed, len(fixed), null


# Rows of a side of a tile of pairs, and query rows whose distances stay in a core's cache.
PAIR_ROWS, _PAIR_STEP = 2048, 256


def _block_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks: a matrix product, and coordinate differences where it would round."""
    if metric != "euclidean":
        return pair_distances(a, b, metric)
    an, bn = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    # Squared lengths ride along as two more coordinates, so the product is the squared distance.
    square = np.column_stack([-2.0 * a, an, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), bn]).T
    least = 8e6 * (a.shape[1] + 4) * np.finfo(float).eps * float(an.max() + bn.max())
    rows = cols = ()
    if square.min() <= least:
        rows, cols = np.nonzero(square <= least)
        square[rows, cols] = 0.0
    np.sqrt(square, out=square)
    if len(rows):
        square[rows, cols] = _gaps(a, rows, b, cols)
    return square


def _tile_sums(a: DataFrame, b: DataFrame, metric: str, permutations: int, seed: int) -> tuple[float, int, DataFrame]:
    """Observed correlation, pairs and the null's, over all pairs of all rows.

    A task takes tiles of two blocks of rows, and adds up the products of their
    distances in one space with those of the relabelled rows in the other; no
    grid is ever formed.  Vectors reach the tasks in slices within the broadcast bound.
    """
    spark = a.sparkSession
    (left_ids, left), (right_ids, right) = held_rows(a), held_rows(b)
    if not np.array_equal(left_ids, right_ids):
        raise LoomError(RESULT_INCOMPATIBLE, "comparison requires aligned sample ids")
    n = len(left)
    if metric == "euclidean":
        # Lengths near the middle leave the products little to round.
        left, right = left - left.mean(axis=0), right - right.mean(axis=0)
    shipped = [shipped_slices(spark, left), shipped_slices(spark, right)]
    # Sums are of distances less their likely size, so that little of them cancels.
    middle = [float(np.sqrt(2.0 * side.var(axis=0).sum())) if metric == "euclidean" else 0.0 for side in (left, right)]
    # Small sets still give every core tiles.
    size = int(np.clip(-(-n // 16), 16, PAIR_ROWS))
    blocks = -(-n // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (np.concatenate([part.value for part in side]) if len(side) > 1 else side[0].value for side in shipped)
        facts, sums = np.zeros(5), np.zeros(permutations + 1)
        for batch in batches:
            for number in ints(batch.column("id")):
                # Tiles on and above the diagonal, numbered row by row of the last block.
                high = int((np.sqrt(8.0 * number + 1) - 1) // 2)
                high += int((high + 1) * (high + 2) // 2 <= number) - int(high * (high + 1) // 2 > number)
                low = int(number - high * (high + 1) // 2)
                rows, cols = np.arange(low * size, min((low + 1) * size, n)), np.arange(high * size, min((high + 1) * size, n))
                fixed = _block_distances(first[rows], first[cols], metric)
                wanted = rows[:, None] < cols[None, :]
                moved = _block_distances(second[rows], second[cols], metric)
                facts[4] += (~np.isclose(fixed, moved) & wanted).sum()
                fixed = np.where(wanted, fixed - middle[0], 0.0)
                moved = np.where(wanted, moved - middle[1], 0.0)
                own = fixed.sum()
                facts[:4] += own, (fixed * fixed).sum(), moved.sum(), (moved * moved).sum()
                sums[0] += (fixed * moved).sum()
                for p in range(permutations):
                    order = np.random.default_rng([seed, p]).permutation(n)
                    here, there = second[order[rows]], second[order[cols]]
                    for at in range(0, len(rows), _PAIR_STEP):
                        part = _block_distances(here[at : at + _PAIR_STEP], there, metric)
                        sums[p + 1] += np.vdot(fixed[at : at + _PAIR_STEP], part)
                    sums[p + 1] -= middle[1] * own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-6, permutations, dtype=np.int64)), pa.array(np.concatenate([facts, sums]))], names=["id", "s"])

    tiles = blocks * (blocks + 1) // 2
    parts = spark.range(0, tiles, 1, min(tiles, max(2 * spark.sparkContext.defaultParallelism, tiles // 16)))
    found = cut_lineage(parts.mapInArrow(run, "id bigint, s double").groupBy("id").agg(F.sum("s").alias("s")))
    total = {r["id"]: r["s"] for r in found.where("id < 0").collect()}
    pairs = n * (n - 1) // 2
    x, xx, y, yy, apart, xy = (total[k] for k in range(-6, 0))
    means = np.array([x / pairs + middle[0], y / pairs + middle[1]])
    spreads = np.sqrt(np.maximum([xx / pairs - (x / pairs) ** 2, yy / pairs - (y / pairs) ** 2], 0.0))
    spread = float(spreads.prod()) * pairs
    if pairs < 2:
        observed = 0.0
    elif not preprocess.meaningful(means, spreads).all():
        observed = 0.0 if apart else 1.0
    else:
        observed = (xy - x * y / pairs) / spread
    null = found.where("id >= 0").select("id", ((F.col("s") - F.lit(x * y / pairs)) / F.lit(spread if spread > 0 else 1.0)).alias("r"))
    return float(observed), pairs, null


MANTEL_SUBSET = 600


def mantel(left: DataFrame, right: DataFrame, params: dict | None = None) -> dict:
    """Permutation test of two distance matrices; permutations run in tasks.

    Distances of all rows count unless ``max_samples`` asks for an evenly spread
    subset.  Ranks of distances need the whole grid, so they are of a subset always.
    """
    params = params or {}
    metric = choice(params, "metric", "euclidean", METRICS)
    method = choice(params, "method", "pearson", ("pearson", "spearman"))
    tail = choice(params, "alternative", "two-sided", ("two-sided", "greater", "less"))
    ranked = method == "spearman"
    whole = not ranked and params.get("max_samples") is None
    limit = None if whole else int_param(params, "max_samples", MANTEL_SUBSET, 3)
    permutations = int_param(params, "permutations", 999)
    seed = seed_param(params)
    a, b, n = _aligned(left, right, params, limit, 3)
    if ranked:
        observed, pairs, null = _grid_sums(a, b, metric, limit, permutations, seed)
    else:
        observed, pairs, null = _tile_sums(a, b, metric, permutations, seed)
    bound = F.lit(observed)
    hit = {"greater": F.col("r") >= bound, "less": F.col("r") <= bound, "two-sided": F.abs("r") >= F.abs(bound)}[tail]
    exceed = null.agg(F.count_if(hit)).first()[0]
    return {"statistic": observed, "p_value": (exceed + 1) / (permutations + 1), "null": null,
            "permutations": permutations, "sample_count": n, "pair_count": pairs}


def neighbor_overlap(left: DataFrame, right: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """``i, overlap``: share of the k nearest common to both spaces."""
    a = self_nearest(left, k, metric).select("i", F.col("indices").alias("a"))
    b = self_nearest(right, k, metric).select("i", F.col("indices").alias("b"))
    return a.join(b, "i").select("i", (F.size(F.array_intersect("a", "b")) / F.size("a")).alias("overlap"))


def adjusted_rand(left: DataFrame, right: DataFrame) -> float:
    """Agreement of two labelings from their contingency table."""
    table = left.select("i", F.col("label").alias("a")).join(right.select("i", F.col("label").alias("b")), "i").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"))

    def pairs(c):
        return F.sum(c * (c - 1) / 2.0)

    both = table.agg(pairs(F.col("n")).alias("both"), F.sum("n").alias("n")).first()
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(F.col("n"))).first()[0]
    columns = table.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(F.col("n"))).first()[0]
    every = both["n"] * (both["n"] - 1) / 2.0
    expected = rows * columns / every if every else 0.0
    top = (rows + columns) / 2.0
    return 1.0 if top == expected else float((both["both"] - expected) / (top - expected))


def compare(left: DataFrame, right: DataFrame, params: dict | None = None) -> dict:
    """Geometry shared by two aligned spaces, on an evenly spread subset."""
    from .clusters import fit_kmeans

    params = params or {}
    limit = int_param(params, "max_samples", 600, 2)
    a, b, n = _aligned(left, right, params, limit, 3)
    upper = np.triu_indices(n, 1)
    da, db = _distance_grid(a, "euclidean", limit)[upper], _distance_grid(b, "euclidean", limit)[upper]
    k = min(int_param(params, "k", 10), n - 1)
    planes = []
    for side in (a, b):
        rows = visual_plane(side).select("i", "coords").toArrow().sort_by("i")
        planes.append(matrix(rows.column("coords")))
    flat = [p / max(float(np.linalg.norm(p)), 1e-15) for p in planes]
    u, _s, vt = np.linalg.svd(flat[1].T @ flat[0])
    clusters = min(int_param(params, "n_clusters", 6, 2), n)
    labels = [fit_kmeans(side, clusters, seed_param(params))["labels"] for side in (a, b)]
    return {
        "pairwise_distance_pearson": _pearson(da, db),
        "pairwise_distance_spearman": _pearson(_ranks(da), _ranks(db)),
        "neighbor_overlap": neighbor_overlap(a, b, k).agg(F.avg("overlap")).first()[0],
        "pca_topology_error": float(np.sqrt(np.mean((flat[0] - flat[1] @ (u @ vt)) ** 2))),
        "clustering_stability": adjusted_rand(*labels),
        "left_effective_dimension": effective_dimension(left, {"preprocess": choice(params, "preprocess", "standardized", preprocess.MODES)})["participation_ratio"],
        "right_effective_dimension": effective_dimension(right, {"preprocess": choice(params, "preprocess", "standardized", preprocess.MODES)})["participation_ratio"],
        "sample_count": n,
    }


OVERLAP_SIZES = (1, 2, 4, 8, 16, 32)


def _ahead(q: np.ndarray, to: np.ndarray, mate: np.ndarray, r_ids: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Which rows of ``r`` lie before a query row's mate by (distance, id).

    A matrix product decides what is clear beyond its rounding; the rest is
    settled by coordinate differences.
    """
    if not len(q) or not len(r):
        return np.zeros((len(q), len(r)), dtype=bool)
    gap = q - to
    own = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    score, slack = _squared_screen(q, r)
    limit = own * own
    room = 2 * slack + 1e-12 * limit
    ahead = score < (limit - room)[:, None]
    rows, cols = np.nonzero((score <= (limit + room)[:, None]) & ~ahead)
    gap = q[rows] - r[cols]
    exact = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    ahead[rows, cols] = (exact < own[rows]) | ((exact == own[rows]) & (r_ids[cols] < mate[rows]))
    return ahead


def _ahead_counts(q_ids: np.ndarray, q: np.ndarray, to: np.ndarray, mate: np.ndarray, r_ids: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many rows of ``r``, but for itself and its mate, lie before a query row's mate, tile by tile."""
    found = np.zeros(len(q), dtype=np.int64)
    if not len(q) or not len(r):
        return found
    gap = q - to
    limit = np.einsum("ij,ij->i", gap, gap)
    apart = [places_of(q_ids, r_ids), places_of(mate, r_ids)]
    for start, columns, square, slack in screened_tiles(q, r):
        mine = slice(start, start + len(square))
        for rows, places in apart:
            square[held_places(rows, places, start, len(square), columns)] = np.inf
        room = 2 * slack + 1e-12 * limit[mine]
        clear = np.count_nonzero(square < (limit[mine] - room)[:, None], axis=1)
        open_ = np.flatnonzero(np.count_nonzero(square <= (limit[mine] + room)[:, None], axis=1) > clear)
        found[mine] += clear
        if len(open_):
            at = open_ + start
            settled = _ahead(q[at], to[at], mate[at], r_ids[columns], r[columns])
            settled &= (r_ids[None, columns] != q_ids[at, None]) & (r_ids[None, columns] != mate[at, None])
            found[at] += settled.sum(axis=1) - clear[open_]
    return found


def rank_contributions(left: DataFrame, right: DataFrame, metric: str, n: int, near: DataFrame | None = None) -> DataFrame:
    """``i, contribution``: where the left space's nearest other stands in the right space.

    Self is excluded by id, so copies keep their true rank.  ``near`` has the left
    space's nearest others, where they are known already.
    """
    first = (self_nearest(left, 1, metric) if near is None else near).select("i", F.col("indices")[0].alias("tag"))
    # The mate's vector rides along, so any slice of the reference can be ranked against it.
    mates = right.select(F.col("i").alias("tag"), F.col("features").alias("mate"))
    query = right.join(first, "i").join(mates, "tag").select("i", F.concat("features", "mate").alias("features"), "tag")
    other = right.select("i", "features", F.lit(0).cast("bigint").alias("tag"))

    def place(q_ids, both, mate, r_ids, r, _rt):
        half = both.shape[1] // 2
        q, to = both[:, :half], both[:, half:]
        if metric == "euclidean":
            return q_ids, _ahead_counts(q_ids, q, to, mate, r_ids, r)
        d = pair_distances(q, r, metric)
        own = np.array([pair_distances(q[[k]], to[[k]], metric)[0, 0] for k in range(len(q))])
        ahead = (d < own[:, None]) | ((d == own[:, None]) & (r_ids[None, :] < mate[:, None]))
        # The mate itself is never ahead of itself, whatever rounding says.
        ahead &= (r_ids[None, :] != q_ids[:, None]) & (r_ids[None, :] != mate[:, None])
        return q_ids, ahead.sum(axis=1).astype(np.int64)

    ranked = broadcast_reduce(
        other, query, place, "i bigint, ahead bigint", lambda parts: parts.groupBy("i").agg(F.sum("ahead").alias("ahead")),
        CHUNK_ROWS if metric == "euclidean" else None)
    share = F.col("ahead") / F.lit(float(max(n - 2, 1)))
    return ranked.select("i", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("contribution"))


def information_imbalance(left: DataFrame, right: DataFrame, params: dict | None = None) -> dict:
    params = params or {}
    metric = choice(params, "metric", "euclidean", METRICS)
    limit = None if params.get("max_samples") is None else int_param(params, "max_samples", 600, 3)
    a, b, n = _aligned(left, right, params, limit, 8)
    sizes = [k for k in OVERLAP_SIZES if k <= n - 1]
    # Both spaces are searched and ranked once; the means, the ranks and the overlap read what was found.
    a, b = cut_lineage(a), cut_lineage(b)
    near_a, near_b = (cut_lineage(self_nearest(side, sizes[-1], metric).select("i", "indices")) for side in (a, b))
    forward, back = cut_lineage(rank_contributions(a, b, metric, n, near_a)), cut_lineage(rank_contributions(b, a, metric, n, near_b))
    near = near_a.select("i", F.col("indices").alias("a")).join(near_b.select("i", F.col("indices").alias("b")), "i")
    shares = near.select("i", *[
        (F.size(F.array_intersect(F.slice("a", 1, k), F.slice("b", 1, k))) / k).alias(f"overlap_{k}") for k in sizes])
    return {
        "forward": forward, "back": back, "overlap": shares, "sizes": sizes, "sample_count": n,
        "delta_a_to_b": forward.agg(F.avg("contribution")).first()[0],
        "delta_b_to_a": back.agg(F.avg("contribution")).first()[0],
    }
