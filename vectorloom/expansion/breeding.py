"""Parents with genomes, as a table that a round of the expansion draws from and renews.

A parent is a row: its rank, its vector, its genes (amplitudes of the structure
changes) and its shares (how readily each change is tried).  A child's parent
is drawn with squared ranks as weights, its genome is the parent's with noise,
and its changes are tried in an order drawn by the shares.  The first slots of
a round go to immigrants, made from seeds with the founder's genome.

The table holds at most ``limit`` parents; beyond it the farthest points of all
stay, in the order they were picked.  Every draw is a hash of its place or is
given, so a repeated task breeds the same children.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import invalid
from ..operators.sampling import farthest_points
from .mutations import AMPLITUDES, GENES

STATE = "rank bigint, i bigint, at array<double>, genes array<double>, shares array<double>"

# The range of each gene, the least share of a change, the greatest
# share of immigrants while the pool is cold and at any time, and how far success
# moves a share.
GENE_RANGE = {"sigma": (0.01, 5.0), "strain": (0.005, 0.5), "shear": (0.005, 0.5)}
LEAST_SHARE = 0.05
COLD_IMMIGRANTS = 0.4
MOST_IMMIGRANTS = 0.9
NEUTRAL_PART = 0.55
FACTOR_RANGE = (0.5, 2.0)


@dataclass(frozen=True)
class Breeding:
    """``warm_pool`` parents are needed before ranks count; with fewer, draws are even and immigrants more."""

    parent_fraction: float = 0.7
    gene_rate: float = 0.3
    warm_pool: int = 0
    weigh_success: bool = False

    def __post_init__(self):
        if not 0.1 <= self.parent_fraction <= 1.0 or self.gene_rate <= 0 or self.warm_pool < 0:
            raise invalid("parent_fraction must be in [0.1, 1], gene_rate above 0 and warm_pool at least 0")


def founder(operators: Mapping[str, dict]) -> tuple[list[float], list[float]]:
    """Genes from the given amplitudes, and equal shares."""
    genes = {"sigma": 0.15, "strain": 0.05, "shear": 0.05}
    for name, params in operators.items():
        if name in AMPLITUDES:
            gene, parameter = AMPLITUDES[name]
            genes[gene] = float(params.get(parameter, genes[gene]))
    return [min(max(genes[g], GENE_RANGE[g][0]), GENE_RANGE[g][1]) for g in GENES], [1.0] * len(operators)


def immigrant_slots(slots: int, pool: int, fraction: float, warm_pool: int) -> int:
    """Slots that go to seeds: all without parents, more than ``fraction`` while the pool is cold."""
    if not pool:
        return slots
    if pool < warm_pool:
        fraction = min(max(fraction, COLD_IMMIGRANTS * (1.0 - pool / warm_pool)), MOST_IMMIGRANTS)
    return min(max(round(fraction * slots), 0), slots)


def rank_weights(pool: int, how: Breeding) -> np.ndarray:
    """Weight of each rank that may be drawn, best first; a cold pool's are equal."""
    if pool < how.warm_pool:
        return np.ones(pool)
    drawn_from = max(1, min(pool, round(how.parent_fraction * pool))) if pool else 0
    return np.arange(drawn_from, 0, -1, dtype=float) ** 2


def nearness(distance: np.ndarray, radius: float) -> np.ndarray:
    """What a distance to the target leaves of a weight."""
    return np.exp(-((np.minimum(distance, 1e12) / max(radius, 1e-12)) ** 2))


def newborn(spark: SparkSession) -> DataFrame:
    """A pool without parents."""
    return spark.createDataFrame([], STATE)


def renewed(pool: DataFrame, accepted: DataFrame, limit: int) -> DataFrame:
    """The pool after a round; ``accepted`` has ``place`` (order of selection) and the pool's columns but ``rank``.

    Accepted rows follow the parents there are.  Of more than ``limit`` rows the
    farthest points stay, starting at the one next to the centre; equal ones
    go by the earlier rank.  Rows without a vector cannot be parents.
    """
    size = pool.count()
    columns = ["rank", "i", "at", "genes", "shares"]
    arrived = accepted.where(F.col("at").isNotNull()).withColumn("rank", F.col("place") + F.lit(size))
    grown = pool.select(*columns).unionByName(arrived.select(*columns))
    if grown.count() <= limit:
        return grown
    picked = farthest_points(grown.select(F.col("rank").alias("i"), F.col("at").alias("features")), limit).ids
    order = pool.sparkSession.createDataFrame([(int(old), new) for new, old in enumerate(picked)], "rank bigint, _new bigint")
    return grown.join(F.broadcast(order), "rank").drop("rank").withColumnRenamed("_new", "rank").select(*columns)


def success_factors(tallies: DataFrame) -> DataFrame:
    """``operator, factor`` from ``operator, proposed, accepted``.

    A change's rate of acceptance is set against the mean rate of those that
    were proposed.  A change never proposed, or every change where none was
    accepted, has factor one.
    """
    rate = F.when(F.col("proposed") > 0, F.col("accepted") / F.col("proposed"))
    level = tallies.agg(F.avg(rate).alias("_mean")).withColumn("_one", F.lit(1))
    told = tallies.withColumn("_rate", rate).withColumn("_one", F.lit(1)).join(F.broadcast(level), "_one")
    least, most = FACTOR_RANGE
    moved = F.lit(NEUTRAL_PART) + F.lit(1.0 - NEUTRAL_PART) * F.col("_rate") / F.col("_mean")
    factor = F.when(F.col("_rate").isNull() | (F.col("_mean") <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), moved)))
    return told.select("operator", factor.alias("factor"))


# --- draws -------------------------------------------------------------------


def _share(*parts: Column) -> Column:
    """Uniform in (0, 1) by a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def drawn(spark: SparkSession, slots: int, children: int, start: int, operators: int, seed: int, generation: int) -> DataFrame:
    """``i, slot, u_parent, normals, u_order``: a row per child and its draws."""
    cells = spark.range(slots * children).select((F.col("id") + F.lit(start)).alias("i"), F.floor(F.col("id") / children).alias("slot"))
    part = lambda kind, k: _share(F.lit(seed), F.lit(generation), F.col("i"), F.lit(kind), F.lit(k))
    normal = lambda k: F.sqrt(-2.0 * F.log(part("length", k))) * F.cos(2.0 * math.pi * part("angle", k))
    return cells.select(
        "i", "slot", part("parent", 0).alias("u_parent"), F.array(*[normal(k) for k in range(len(GENES) + operators)]).alias("normals"),
        F.array(*[part("order", k) for k in range(operators)]).alias("u_order"))


def _lot(weights: Sequence[float]):
    """A draw in [0, 1) to a place among weights; the bounds are those of one pool and its seeds."""
    bounds = np.cumsum(np.asarray(weights, dtype=float))

    @F.pandas_udf("bigint")
    def place(u: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(bounds, u.to_numpy() * bounds[-1], side="right"), len(bounds) - 1))

    return place


def children(draws: DataFrame, pool: DataFrame, seeds: DataFrame, operators: Mapping[str, dict], weights: Sequence[float],
             seed_weights: Sequence[float], immigrants: int, how: Breeding, factors: Mapping[str, float] | None = None,
             beside: Sequence[float] = ()) -> DataFrame:
    """``i, parent, operator, tries, genes, shares`` of a round's children.

    ``seeds`` has ``place, seed`` numbered from zero, and ``seed_weights`` their
    weights for immigrants.  ``weights`` are of the pool's first ranks, later
    ones are not drawn.  A targeted round draws seeds ``beside`` the parents.
    ``tries`` names the changes in the order they are tried.
    """
    names = list(operators)
    genes, shares = founder(operators)
    size = pool.count()
    lots = pool.select(F.col("rank").alias("_lot"), F.col("i").alias("parent"), F.col("genes").alias("_genes"), F.col("shares").alias("_shares")).unionByName(
        seeds.select((F.col("place") + F.lit(size)).alias("_lot"), F.col("seed").alias("parent"), F.array(*map(F.lit, genes)).alias("_genes"),
                     F.array(*map(F.lit, shares)).alias("_shares")))
    fills = [*weights, *[0.0] * (size - len(weights)), *beside]
    fresh = F.col("slot") < F.lit(immigrants)
    from_seeds = _lot(seed_weights)(F.col("u_parent")) + F.lit(size)
    lot = from_seeds if not sum(fills) else F.when(fresh, from_seeds).otherwise(_lot(fills)(F.col("u_parent")))
    told = draws.withColumn("_lot", lot).join(lots, "_lot")

    def moved(value: Column, k: int, low: float, high: float) -> Column:
        noisy = F.greatest(F.lit(low), F.least(F.lit(high), value * (1.0 + F.lit(how.gene_rate) * F.col("normals")[k])))
        return F.when(fresh, value).otherwise(noisy)

    told = told.withColumn("genes", F.array(*[moved(F.col("_genes")[k], k, *GENE_RANGE[g]) for k, g in enumerate(GENES)]))
    told = told.withColumn("shares", F.array(*[moved(F.col("_shares")[k], len(GENES) + k, LEAST_SHARE, 1.0) for k in range(len(names))]))
    # The least of -log(u) / weight falls to each name in proportion to its weight, also among those that apply.
    wait = [F.struct((-F.log(F.col("u_order")[k]) / (F.col("shares")[k] * F.lit((factors or {}).get(n, 1.0)))).alias("wait"), F.lit(n).alias("name")) for k, n in enumerate(names)]
    told = told.withColumn("tries", F.transform(F.array_sort(F.array(*wait)), lambda w: w["name"]))
    return told.select("i", "parent", F.col("tries")[0].alias("operator"), "tries", "genes", "shares")
