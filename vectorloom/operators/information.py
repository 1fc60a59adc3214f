"""Mutual information of features with a target, by neighbour counts.

For each row the k-th nearest other row in the plane of (feature, target) gives
a radius, the larger of the two coordinate gaps; the information follows from
how many rows lie nearer than that radius in the feature alone and in the target
alone.  Both sides are scaled by their spread.

While two columns fit the broadcast bound, tasks take (feature, stretch of rows)
pairs: rows are swept in the order of one side, in a window that widens until
its edges are farther than the k-th distance.  Beyond the bound the plane is
searched like any other space, and the counts are differences of ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import ints, matrix
from ..errors import insufficient, invalid
from ..session import broadcast_bytes
from . import preprocess
from .neighbors import nearest
from .ordering import running_totals

STRETCH_ROWS = 4096
_TEMP_VALUES = 2 << 20
# A neighbour at just the radius is not nearer than it, however its coordinates round.
_INSIDE = 1 - 1e-12


def digamma(m):
    """For whole numbers from one; works on arrays and on columns."""
    wide = m + 10.0
    log = F.log(wide) if isinstance(m, Column) else np.log(wide)
    inverse = 1.0 / (wide * wide)
    series = log - 0.5 / wide - inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240)))
    for step in range(10):
        series = series - 1.0 / (m + float(step))
    return series


def kth_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Distance of some rows to their k-th nearest other row in the plane; ``a`` ascends."""
    found, left, width = np.full(len(rows), np.inf), np.arange(len(rows)), max(8, 2 * k)
    while len(left):
        width = min(width, len(a))
        again = []
        step = max(1, _TEMP_VALUES // (2 * width + 1))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            place = rows[part]
            near = place[:, None] + np.arange(-width, width + 1)[None, :]
            inside = (near >= 0) & (near < len(a)) & (near != place[:, None])
            near = np.clip(near, 0, len(a) - 1)
            gap = np.where(inside, np.maximum(np.abs(a[near] - a[place][:, None]), np.abs(b[near] - b[place][:, None])), np.inf)
            kth = np.partition(gap, k - 1, axis=1)[:, k - 1]
            found[part] = kth
            low, high = place - width - 1, place + width + 1
            below = np.where(low >= 0, a[place] - a[np.maximum(low, 0)], np.inf)
            above = np.where(high < len(a), a[np.minimum(high, len(a) - 1)] - a[place], np.inf)
            again.append(part[np.minimum(below, above) < kth])
        left = np.concatenate(again)
        width *= 2
    return found


def _first_within(ordered: np.ndarray, value: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The first place in an ascending array whose gap below ``value`` is at most ``radius``; by differences, so that none is rounded in."""
    low, high = np.zeros(len(value), dtype=np.int64), np.searchsorted(ordered, value, "left")
    while (open_ := low < high).any():
        mid = (low + high) // 2
        far = value - ordered[np.minimum(mid, len(ordered) - 1)] > radius
        low, high = np.where(open_ & far, mid + 1, low), np.where(open_ & ~far, mid, high)
    return low


def counts_within(ordered: np.ndarray, value: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of the ascending values are nearer than ``radius``, or equal where it is zero; the value itself counts."""
    radius = np.nextafter(radius, 0.0)
    first = _first_within(ordered, value, radius)
    # The same from above, on the mirrored order.
    last = len(ordered) - _first_within(-ordered[::-1], -value, radius)
    return last - first


class Sweep:
    """A feature and the target in the order of the side with more distinct values."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        a, b = (x, y) if len(np.unique(x)) >= len(np.unique(y)) else (y, x)
        order = np.lexsort((b, a))
        self.a, self.b, self.ordered = a[order], b[order], np.sort(b)

    def sums(self, start: int, k: int) -> tuple[float, int]:
        """Sum of both sides' digammas over a stretch of the order, and its rows."""
        rows = np.arange(start, min(start + STRETCH_ROWS, len(self.a)))
        radius = kth_distances(self.a, self.b, rows, k)
        counts = counts_within(self.a, self.a[rows], radius), counts_within(self.ordered, self.b[rows], radius)
        return float(sum(digamma(c.astype(float)).sum() for c in counts)), len(rows)


def _by_sweep(scaled: DataFrame, features: list[int], n: int, k: int) -> DataFrame:
    """``f, total, n`` per stretch; as many columns at a time as the bound allows."""
    spark = scaled.sparkSession
    at_once = max(1, broadcast_bytes(spark) // (8 * n) - 1)
    stretches = -(-n // STRETCH_ROWS)
    out = None
    for first in range(0, len(features), at_once):
        group = features[first : first + at_once]
        listed = F.transform(F.array(*[F.lit(f) for f in group]), lambda f: F.get(F.col("features"), f))
        packed = scaled.select("y", listed.alias("x")).toArrow()
        shared = spark.sparkContext.broadcast((matrix(packed.column("x")), ints(packed.column("y").combine_chunks()), group))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y, group = shared.value
            swept = sweep = None
            for batch in batches:
                found = []
                for f, stretch in (divmod(cell, stretches) for cell in batch.column("id").to_pylist()):
                    # A task's cells are in a row, so mostly of one feature.
                    if swept != f:
                        swept, sweep = f, Sweep(x[:, f], y)
                    found.append((group[f], *sweep.sums(stretch * STRETCH_ROWS, k)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["f", "total", "n"])

        cells = len(group) * stretches
        part = spark.range(0, cells, 1, min(cells, 4096)).mapInArrow(work, "f bigint, total double, n bigint")
        out = part if out is None else out.unionByName(part)
    return out


def _rank_counts(points: DataFrame, value: str) -> DataFrame:
    """``i, hits``: rows nearer than ``radius`` in one column, by ranks of both ends of the stretch."""
    reach = F.col("radius") * _INSIDE
    ends = points.select("i", (F.col(value) - reach).alias("low"), (F.col(value) + reach).alias("high"))
    marks = points.select(F.col(value).alias("v"), F.lit(1).alias("one"))
    for end in ("low", "high"):
        marks = marks.unionByName(ends.select(F.col(end).alias("v"), F.lit(0).alias("one")))
    placed = running_totals(marks.withColumn("_all", F.lit(0)).groupBy("_all", "v").agg(F.sum("one").alias("one")), ["_all"], "v", "one")
    below = placed.select(F.col("v").alias("low"), F.col("before").alias("_low"))
    through = placed.select(F.col("v").alias("high"), (F.col("before") + F.col("one")).alias("_high"))
    return ends.join(below, "low").join(through, "high").select("i", (F.col("_high") - F.col("_low")).alias("hits"))


def _by_search(scaled: DataFrame, features: list[int], k: int) -> DataFrame:
    """The same sums where no column pair fits the bound: a search of the plane for each feature."""
    out = None
    for f in features:
        pair = scaled.select("i", F.get(F.col("features"), f).alias("x"), "y")
        plane = pair.select("i", F.array("x", "y").alias("features"))
        radius = nearest(plane, plane, k, "chebyshev", skip_self=True).select("i", F.element_at("distances", k).alias("radius"))
        points = pair.join(radius, "i")
        both = _rank_counts(points, "x").unionByName(_rank_counts(points, "y"))
        part = both.agg(F.sum(digamma(F.col("hits").cast("double"))).alias("total"), (F.count(F.lit(1)) / 2).cast("bigint").alias("n"))
        part = part.select(F.lit(f).cast("bigint").alias("f"), "total", "n")
        out = part if out is None else out.unionByName(part)
    return out


def mutual_information(rows: DataFrame, k: int = 3) -> DataFrame:
    """``f, mutual_information`` in nats for each feature with spread; ``rows`` has ``i, features, y``.

    Never below zero.  Equal rows are neighbours at distance zero; no noise is added.
    """
    n, mean, std = preprocess.feature_moments(rows)
    if n < 3:
        raise insufficient(3, n)
    keep = [int(f) for f in np.flatnonzero(preprocess.meaningful(mean, std))]
    level, spread = rows.agg(F.avg("y"), F.stddev_pop("y")).first()
    if not keep or not preprocess.meaningful(np.array([level]), np.array([spread]))[0]:
        raise invalid("mutual information requires a feature and a target with spread")
    k = min(k, n - 1)
    widths = F.array(*[F.lit(float(s) or 1.0) for s in std])
    scaled = rows.select("i", F.zip_with("features", widths, lambda x, s: x / s).alias("features"), (F.col("y") / F.lit(float(spread))).alias("y"))
    fits = 16 * n <= broadcast_bytes(rows.sparkSession)
    found = _by_sweep(scaled, keep, n, k) if fits else _by_search(scaled, keep, k)
    known = float(digamma(np.array([float(n)]))[0] + digamma(np.array([float(k)]))[0])
    return found.groupBy("f").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select(
        F.col("f").cast("int").alias("f"), F.greatest(F.lit(0.0), F.lit(known) - F.col("total") / F.col("n")).alias("mutual_information"))
