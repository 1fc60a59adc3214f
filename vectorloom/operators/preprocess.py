"""Scaling fitted once per set and applied as a Column expression.

A fit is one job that returns a few numbers per feature; applying it is a
projection, so nothing is shuffled and nothing is copied.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions.vec import RELATIVE_TOLERANCE, all_finite, finite, literal, unpivot
from .ordering import exact_quantiles

MODES = ("raw", "center", "standardized")


def meaningful(centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features whose spread is more than rounding noise at their own size."""
    return np.asarray(scale) > RELATIVE_TOLERANCE * np.maximum(np.abs(np.asarray(centre)), 1.0)


@dataclass(frozen=True)
class Scaler:
    """``(x - centre) / scale`` on the kept features."""

    keep: tuple[int, ...]
    centre: tuple[float, ...] | None
    scale: tuple[float, ...] | None
    rows: int
    width: int
    warnings: tuple[str, ...] = field(default=())

    def column(self, features: Column) -> Column:
        if len(self.keep) != self.width:
            features = F.transform(F.array(*[F.lit(k) for k in self.keep]), lambda k: F.get(features, k))
        if self.centre is not None:
            features = F.zip_with(features, literal(self.centre), lambda x, c: x - c)
        if self.scale is not None:
            features = F.zip_with(features, literal(self.scale), lambda x, s: x / s)
        return features

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", self.column(F.col("features")))


def feature_moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population standard deviations, refusing bad input."""
    long = unpivot(df)
    rows = (
        long.groupBy("f")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(finite(F.col("x"))).alias("good"),
            F.avg("x").alias("mean"),
            F.stddev_pop("x").alias("std"),
        )
        .orderBy("f")
        .collect()
    )
    if not rows:
        raise invalid("analysis input cannot be empty")
    bad = sum(r["n"] - r["good"] for r in rows)
    if bad:
        raise invalid("analysis input contains NaN or Inf", bad_values=bad)
    if len({r["n"] for r in rows}) != 1:
        raise invalid("rows have different feature counts")
    return rows[0]["n"], np.array([r["mean"] for r in rows]), np.array([r["std"] for r in rows])


def fit(df: DataFrame, mode: str = "standardized", allow_empty: bool = False) -> Scaler:
    """Single-set scaling: constant features are dropped in every mode."""
    if mode not in MODES:
        raise invalid("preprocess must be raw, center, or standardized")
    n, mean, std = feature_moments(df)
    informative = meaningful(mean, std)
    keep = np.flatnonzero(informative)
    warnings = () if len(keep) == len(mean) else (f"ignored {len(mean) - len(keep)} zero-variance feature(s)",)
    if not len(keep) and not allow_empty:
        raise invalid("analysis requires at least one informative feature")
    return Scaler(
        keep=tuple(int(k) for k in keep),
        centre=None if mode == "raw" else tuple(mean[keep]),
        scale=tuple(std[keep]) if mode == "standardized" else None,
        rows=int(n),
        width=len(mean),
        warnings=warnings,
    )


def fit_reference(reference: DataFrame, mode: str = "standardized") -> Scaler:
    """Cross-set scaling: fitted on the reference, constant features kept at unit scale."""
    if mode not in MODES:
        raise invalid("preprocess must be raw, center, or standardized")
    n, mean, std = feature_moments(reference)
    constant = ~meaningful(mean, std)
    warnings = ()
    if constant.any() and mode != "raw":
        warnings = (f"retained {int(constant.sum())} reference-constant feature(s) with unit scale",)
    return Scaler(
        keep=tuple(range(len(mean))),
        centre=None if mode == "raw" else tuple(mean),
        scale=tuple(np.where(constant, 1.0, std)) if mode == "standardized" else None,
        rows=int(n),
        width=len(mean),
        warnings=warnings,
    )


# Fixed value: quartile distance of a unit normal.
IQR_PER_SIGMA = 1.349


def fit_sampling(df: DataFrame, mode: str = "robust") -> Scaler:
    """Sampling scaling: nothing dropped; robust falls back to std, then to one."""
    if mode not in ("raw", "standardized", "robust"):
        raise invalid("scaling must be raw, standardized, or robust")
    n, mean, std = feature_moments(df)
    everything = tuple(range(len(mean)))
    if mode == "raw":
        return Scaler(everything, None, None, int(n), len(mean))
    spread = np.where(meaningful(mean, std), std, 1.0)
    if mode == "standardized":
        return Scaler(everything, tuple(mean), tuple(spread), int(n), len(mean))
    rows = exact_quantiles(unpivot(df), ["f"], "x", [0.25, 0.5, 0.75], ["a", "b", "c"]).orderBy("f").collect()
    median = np.array([r["b"] for r in rows])
    sigma = np.array([r["c"] - r["a"] for r in rows]) / IQR_PER_SIGMA
    return Scaler(everything, tuple(median), tuple(np.where(meaningful(median, sigma), sigma, spread)), int(n), len(mean))


def refuse_non_finite(df: DataFrame) -> DataFrame:
    """The same rows, failing at run time on the first bad vector."""
    check = F.when(all_finite(F.col("features")), F.col("features")).otherwise(
        F.raise_error(F.concat(F.lit("ANALYSIS_INPUT_INVALID: NaN or Inf in row "), F.col("i").cast("string")))
    )
    return df.withColumn("features", check)


def bounded_subset(df: DataFrame, rows: int, limit: int, position: str = "i") -> DataFrame:
    """Evenly spread rows: ``trunc(k * (rows-1) / (limit-1))`` for k below limit.

    ``position`` holds dense 0-based places.  All rows when they fit.
    """
    if rows <= limit:
        return df
    picks = sorted(set(int(v) for v in np.linspace(0, rows - 1, limit, dtype=np.int64)))
    wanted = df.sparkSession.createDataFrame([(p,) for p in picks], f"`{position}` bigint")
    return df.join(F.broadcast(wanted), position, "left_semi")
