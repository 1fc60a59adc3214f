"""Vector arithmetic as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: spread below this share of the magnitude counts as constant.
RELATIVE_TOLERANCE = 1e-12


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(column: Column) -> Column:
    return column.cast("array<double>")


def total(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """1 - similarity, with the norm product and the result kept from below."""
    similarity = dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-15))
    return F.greatest(F.lit(1.0) - similarity, F.lit(0.0))


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"euclidean": euclidean, "manhattan": manhattan, "cosine": cosine}[metric](a, b)


def similarity(metric: str, d: Column) -> Column:
    return F.lit(1.0) - d if metric == "cosine" else F.lit(1.0) / (F.lit(1.0) + d)


def row_mean(a: Column) -> Column:
    return total(a) / F.size(a)


def row_std(a: Column) -> Column:
    """Population standard deviation of one vector."""
    mean = row_mean(a)
    return F.sqrt(total(F.transform(a, lambda x: (x - mean) * (x - mean))) / F.size(a))


def finite(x: Column) -> Column:
    """NaN and infinities become null, so aggregates skip them."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def all_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def feature_rows(df: DataFrame, id_col: str, vector_col: str, *keep: str | Column) -> DataFrame:
    """The shape every operator takes: ``i``, ``features`` and any extra columns."""
    return df.select(F.col(id_col).cast("bigint").alias("i"), doubles(F.col(vector_col)).alias("features"), *keep)


def unpivot(df: DataFrame, *keep: str) -> DataFrame:
    """One row per (row, feature): columns ``f`` and ``x``."""
    return df.select(*keep, F.posexplode("features").alias("f", "x"))
