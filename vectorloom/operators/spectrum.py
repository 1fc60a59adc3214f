"""Covariance spectra, projections, kernels and intrinsic dimension."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import held_rows, ints, matrix, shipped_slices, small_matrix, table_batches, vectors
from ..errors import insufficient, invalid
from ..params import choice, float_param, int_param
from ..session import cut_lineage
from . import preprocess
from .neighbors import CHUNK_ROWS, self_nearest
from .ordering import positions, quantile_values

THRESHOLDS = (0.9, 0.95, 0.99)


@dataclass(frozen=True)
class Moments:
    rows: int
    mean: np.ndarray
    std: np.ndarray
    correlation: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        """Population covariance."""
        return self.correlation * np.outer(self.std, self.std)


def second_moments(df: DataFrame) -> Moments:
    """Means, deviations and correlations: two distributed aggregates, d x d out."""
    n, mean, std = preprocess.feature_moments(df)
    informative = preprocess.meaningful(mean, std)
    full = np.zeros((len(mean), len(mean)))
    keep = np.flatnonzero(informative)
    if len(keep) and n > 1:
        scaler = preprocess.Scaler(tuple(int(k) for k in keep), tuple(mean[keep]), tuple(std[keep]), n, len(mean))
        points = df.select(array_to_vector(scaler.column(F.col("features"))).alias("v"))
        if len(keep) == 1:
            full[keep[0], keep[0]] = 1.0
        else:
            full[np.ix_(keep, keep)] = Correlation.corr(points, "v").head()[0].toArray()
    return Moments(n, mean, np.where(informative, std, 0.0), full)


def _ordered_eigen(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, axes = np.linalg.eigh(symmetric)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    # Largest coefficient positive, so a sign never depends on the solver.
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return values, axes * np.where(signs == 0, 1.0, signs)


def project(df: DataFrame, centre: np.ndarray, axes: np.ndarray, name: str = "coords") -> DataFrame:
    """Adds coordinates along the given axes; one matrix product per batch."""
    shared = df.sparkSession.sparkContext.broadcast((centre, axes))
    rest = [c for c in df.columns if c != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, basis = shared.value
        for batch in table_batches(batches, 4 * CHUNK_ROWS):
            coords = (matrix(batch.column("features")) - middle) @ basis
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors(coords)], names=[*batch.schema.names, name])

    return df.select(*rest).mapInArrow(run, f"{schema}, `{name}` array<double>")


@dataclass(frozen=True)
class Projection:
    table: DataFrame
    explained: np.ndarray
    axes: np.ndarray


def pca(df: DataFrame, params: dict | None = None, components: int = 2) -> Projection:
    """Leading coordinates and every component's share of the variance."""
    params = params or {}
    scaler = preprocess.fit(df, choice(params, "preprocess", "center", preprocess.MODES))
    scaled = scaler.apply(df)
    stats = second_moments(scaled)
    values, axes = _ordered_eigen(stats.covariance)
    count = min(stats.rows, len(values))
    total = values[:count].sum()
    explained = values[:count] / total if total > 0 else np.zeros(count)
    basis = np.zeros((axes.shape[0], components))
    basis[:, : min(components, axes.shape[1])] = axes[:, :components]
    return Projection(project(scaled, stats.mean, basis), explained, axes)


def visual_plane(df: DataFrame) -> DataFrame:
    """Two-dimensional companion coordinates of already scaled features."""
    stats = second_moments(df)
    _values, axes = _ordered_eigen(stats.covariance)
    basis = np.zeros((axes.shape[0], 2))
    basis[:, : min(2, axes.shape[1])] = axes[:, :2]
    return project(df, stats.mean, basis)


def joint_plane(reference: DataFrame, query: DataFrame) -> DataFrame:
    """Both sets in one plane fitted on their union, with a source flag."""
    stacked = reference.select("i", "features", F.lit(0).alias("source")).unionByName(
        query.select("i", "features", F.lit(1).alias("source")))
    return visual_plane(stacked)


def effective_dimension(df: DataFrame, params: dict | None = None) -> dict:
    """Participation ratio and components needed for given variance shares."""
    params = params or {}
    mode = choice(params, "preprocess", "standardized", preprocess.MODES)
    scaler = preprocess.fit(df, mode, allow_empty=True)
    if scaler.rows < 2:
        raise insufficient(2, scaler.rows)
    if not scaler.keep:
        return {"participation_ratio": 0.0, "components": {t: 0 for t in THRESHOLDS}, "eigenvalues": np.zeros(0)}
    stats = second_moments(scaler.apply(df))
    spread = stats.covariance
    if mode == "raw":
        spread = spread + np.outer(stats.mean, stats.mean)
    values, _axes = _ordered_eigen(spread * stats.rows / (stats.rows - 1))
    values = values[: min(stats.rows, len(values))]
    share = values / values.sum()
    reached = np.cumsum(share)
    return {
        "participation_ratio": float(1.0 / np.sum(share * share)),
        "components": {t: int(np.searchsorted(reached, t) + 1) for t in THRESHOLDS},
        "eigenvalues": values,
        "explained_variance": share,
    }


# --- kernels -----------------------------------------------------------------


def bounded_rows(df: DataFrame, limit: int | None, rows: int | None = None) -> DataFrame:
    """The evenly spread subset that the caller asks for; everything where no limit is given or all rows fit."""
    if limit is None:
        return df
    rows = df.count() if rows is None else rows
    if rows <= limit:
        return df
    return preprocess.bounded_subset(positions(df, "i"), rows, limit, "pos").drop("pos")


# Rows whose spectrum is taken where the caller names no number.
KERNEL_SUBSET = 400
# Values of kernel rows that a task holds at a time, and pairs that it compares in all.
KERNEL_VALUES, KERNEL_PAIRS = 2 << 20, 1 << 27


def kernel_rows(df: DataFrame, params: dict | None = None) -> DataFrame:
    """One kernel-matrix row per sample: ``i, kernel array<double>`` in id order.

    All rows against all, unless ``max_samples`` asks for an evenly spread subset.
    A task goes over a few rows at a time; the vectors reach it in slices, each
    within the broadcast bound.
    """
    params = params or {}
    kind = choice(params, "kernel", "rbf", ("linear", "cosine", "polynomial", "rbf"))
    limit = None if params.get("max_samples") is None else int_param(params, "max_samples", KERNEL_SUBSET, 2)
    scaler = preprocess.fit(df, choice(params, "preprocess", "standardized", preprocess.MODES))
    subset = bounded_rows(scaler.apply(df).select("i", "features"), limit, scaler.rows)
    width = len(scaler.keep)
    gamma = params.get("gamma")
    gamma = 1.0 / max(width, 1) if gamma is None else float_param(params, "gamma", 1.0, 0.0)
    degree, offset = int_param(params, "degree", 3), float_param(params, "coef0", 1.0)
    _ids, points = held_rows(subset)
    slices = shipped_slices(df.sparkSession, points)
    step = max(1, min(256, KERNEL_VALUES // max(1, len(points))))

    def against(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
        product = mine @ other.T
        if kind == "cosine":
            lengths = np.linalg.norm(mine, axis=1)[:, None] * np.linalg.norm(other, axis=1)[None, :]
            product = product / np.where(lengths > 0, lengths, 1.0)
        elif kind == "polynomial":
            product = (gamma * product + offset) ** degree
        elif kind == "rbf":
            square = (mine**2).sum(1)[:, None] + (other**2).sum(1)[None, :] - 2 * product
            product = np.exp(-gamma * np.maximum(square, 0.0))
        return product

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_batches(batches, step):
            mine = matrix(batch.column("features"))
            rows = np.hstack([against(mine, shared.value) for shared in slices])
            yield pa.RecordBatch.from_arrays([batch.column("i"), vectors(rows)], names=["i", "kernel"])

    # Few input files still give every core rows to compare.
    if len(points) * len(points) > KERNEL_VALUES:
        subset = subset.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-len(points) * len(points) // KERNEL_PAIRS)))
    return subset.mapInArrow(run, "i bigint, kernel array<double>")


def kernel_spectrum(df: DataFrame, params: dict | None = None) -> dict:
    """Spectrum of the double-centred kernel over the bounded subset."""
    params = dict(params or {})
    rows = kernel_rows(df, {**params, "max_samples": int_param(params, "max_samples", KERNEL_SUBSET, 2)}).toArrow()
    order = np.argsort(ints(rows.column("i").combine_chunks()))
    full = matrix(rows.column("kernel"))[order]
    centred = full - full.mean(0)[None, :] - full.mean(1)[:, None] + full.mean()
    values = np.linalg.eigvalsh(centred)[::-1]
    share = np.maximum(values, 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    used = share[share > 0]
    return {
        "eigenvalues": values,
        "effective_rank": float(np.exp(-(used * np.log(used)).sum())) if len(used) else 0.0,
        "top_eigenvalue_fraction": float(share[0]) if len(share) else 0.0,
        "kernel_min": float(full.min()),
        "kernel_max": float(full.max()),
    }


# --- intrinsic dimension -----------------------------------------------------


def neighbor_ratios(df: DataFrame, params: dict | None = None) -> DataFrame:
    """``i, r1, r2, ln_mu`` for rows that are not copies of another."""
    params = params or {}
    metric = choice(params, "metric", "euclidean", ("euclidean", "cosine", "manhattan"))
    tolerance = float_param(params, "duplicate_tolerance", 1e-9, 1e-15, 1e-3)
    scaler = preprocess.fit(df, choice(params, "preprocess", "standardized", preprocess.MODES))
    if scaler.rows < 4:
        raise insufficient(4, scaler.rows)
    limit = None if params.get("max_samples") is None else int_param(params, "max_samples", 5000, 4)
    subset = bounded_rows(scaler.apply(df).select("i", "features"), limit, scaler.rows)
    # Read for the largest, the mean and the resamples; searched once.
    pairs = cut_lineage(self_nearest(subset, 2, metric).select(
        "i", F.col("distances")[0].alias("r1"), F.col("distances")[1].alias("r2")))
    largest = pairs.agg(F.max("r2")).first()[0]
    kept = pairs.where(F.col("r1") > tolerance * max(largest, 1e-300))
    return kept.withColumn("ln_mu", F.log(F.col("r2") / F.col("r1")))


def two_nn_dimension(df: DataFrame, params: dict | None = None) -> dict:
    """Maximum-likelihood dimension from two-neighbour ratios, with a bootstrap.

    A resample counts each row a Poisson number of times, drawn from a hash of its
    id and the replicate, so tasks only add up and no ratio leaves its task.
    """
    params = params or {}
    ratios = neighbor_ratios(df, params)
    stats = ratios.agg(F.count("ln_mu").alias("n"), F.avg("ln_mu").alias("mean")).first()
    if stats["n"] < 4:
        raise insufficient(4, stats["n"])
    if stats["mean"] <= 0:
        raise invalid("neighbour ratios are degenerate on this set")
    replicates = int_param(params, "n_bootstrap", 32, 0)
    result = {"intrinsic_dimension": 1.0 / stats["mean"], "points_used": stats["n"], "bootstrap": None}
    if replicates:
        spark = df.sparkSession
        seed = int_param(params, "seed", 42, 0)
        # Chances of a Poisson count of mean one, added up.
        steps = np.cumsum([math.exp(-1.0) / math.factorial(c) for c in range(16)])

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            times, sums = np.zeros(replicates), np.zeros(replicates)
            for batch in batches:
                values, own = np.asarray(batch.column("ln_mu")), ints(batch.column("i")).astype(np.uint64)
                for r in range(replicates):
                    x = own * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + r + 1) * 0xD1B54A32D192ED03 % (1 << 64))
                    for shift in (30, 27):
                        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
                    count = np.searchsorted(steps, (x >> np.uint64(11)) / float(1 << 53), side="right")
                    times[r] += count.sum()
                    sums[r] += (count * values).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(times), pa.array(sums)], names=["id", "n", "s"])

        parts = ratios.select("i", "ln_mu").mapInArrow(draw, "id bigint, n double, s double")
        draws = parts.groupBy("id").agg((F.sum("n") / F.sum("s")).alias("d"))
        base = draws.agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).first()
        low, high = quantile_values(draws, "d", [0.025, 0.975])
        result["bootstrap"] = {"mean": base["mean"], "sd": base["sd"] or 0.0, "ci95": [low, high], "draws": replicates}
    return result


def pairwise_rows(df: DataFrame, params: dict | None = None) -> DataFrame:
    """``i, distances, similarities``: matrix rows of the bounded subset in id order."""
    from ..functions.vec import similarity
    from .neighbors import METRICS, pair_distances

    params = params or {}
    metric = choice(params, "metric", "cosine", METRICS)
    limit = int_param(params, "max_samples", 400, 2)
    scaler = preprocess.fit(df, choice(params, "preprocess", "raw", preprocess.MODES))
    subset = bounded_rows(scaler.apply(df).select("i", "features"), limit, scaler.rows)
    _ids, points = small_matrix(subset, "pairwise subset", limit)
    shared = df.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_batches(batches, 256):
            rows = pair_distances(matrix(batch.column("features")), shared.value, metric)
            yield pa.RecordBatch.from_arrays([batch.column("i"), vectors(rows)], names=["i", "distances"])

    found = subset.mapInArrow(run, "i bigint, distances array<double>")
    return found.withColumn("similarities", F.transform("distances", lambda d: similarity(metric, d)))
