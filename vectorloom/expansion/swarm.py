"""A swarm of particles as a table that a round of the expansion advances by joins.

A particle is a row: where it is, the best place it has been, and how far that
place's fitness lay above its round's mean.  A child is made from the place that
pulls most: the particle's own best, the leader's best, the anchor's seed, or,
where a drawn amount of change outweighs them, the particle's place itself.
Pulls are drawn shares of a weight times the distance to the place.

Places are candidate ids with their vectors; structures stay in their tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import euclidean

STATE = "slot bigint, position bigint, position_at array<double>, best bigint, best_at array<double>, best_z double"
# A draw for the reset, one for each pull, one for the seed and one for the change.
DRAWS = ("u_reset", "u_best", "u_leader", "u_change", "u_anchor", "u_seed", "u_operator")


@dataclass(frozen=True)
class Pulls:
    best: float = 1.0
    leader: float = 1.5
    change: float = 0.5
    anchor: float = 1.0


def newborn(spark: SparkSession, slots: int) -> DataFrame:
    """Particles without a memory."""
    return spark.range(slots).selectExpr(
        "id AS slot", "CAST(NULL AS BIGINT) AS position", "CAST(NULL AS ARRAY<DOUBLE>) AS position_at", "CAST(NULL AS BIGINT) AS best",
        "CAST(NULL AS ARRAY<DOUBLE>) AS best_at", "CAST(NULL AS DOUBLE) AS best_z")


def drawn(state: DataFrame, children: int, seed: int, generation: int) -> DataFrame:
    """``slot, child`` and the draws, each uniform in [0, 1) by a hash of its place."""
    cells = state.select("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(children - 1).cast("bigint"))).alias("child"))
    share = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(generation), "slot", "child", F.lit(k)), 11) / F.lit(float(1 << 53))
    return cells.select("slot", "child", *[share(k).alias(name) for k, name in enumerate(DRAWS)])


def leader_of(state: DataFrame) -> DataFrame:
    """One row ``leader, leader_at``: the best place of all particles, of equal ones the first slot's; none without memory."""
    first = state.where("best_z IS NOT NULL").agg(F.min(F.struct((-F.col("best_z")).alias("z"), "slot", "best", "best_at")).alias("_b"))
    return first.where("_b IS NOT NULL").select(F.lit(1).alias("_one"), F.col("_b.best").alias("leader"), F.col("_b.best_at").alias("leader_at"))


def _apart(a: str, b: str) -> Column:
    return F.coalesce(euclidean(F.col(a), F.col(b)), F.lit(0.0))


def targets(state: DataFrame, draws: DataFrame, pulls: Pulls, reset: float, anchor: DataFrame | None = None) -> DataFrame:
    """``slot, child, parent`` and the draws for the seed and the change; a null parent asks for a seed.

    ``anchor`` is one row ``anchor, anchor_at``.  Particles without a best place
    and children whose first draw is below ``reset`` take a seed.
    """
    told = state.withColumn("_one", F.lit(1)).join(F.broadcast(leader_of(state)), "_one", "left")
    if anchor is None:
        told = told.withColumn("anchor", F.lit(None).cast("bigint")).withColumn("anchor_at", F.lit(None).cast("array<double>"))
    else:
        told = told.join(F.broadcast(anchor.select(F.lit(1).alias("_one"), "anchor", "anchor_at")), "_one", "left")
    told = draws.join(told, "slot")
    to_best, to_leader, to_anchor = (F.col(u) * F.lit(w) * _apart("position_at", at) for u, w, at in (
        ("u_best", pulls.best, "best_at"), ("u_leader", pulls.leader, "leader_at"), ("u_anchor", pulls.anchor, "anchor_at")))
    change = F.col("u_change") * F.lit(pulls.change)
    told = told.withColumn("_best", to_best).withColumn("_leader", to_leader).withColumn("_change", change).withColumn("_anchor", to_anchor)
    strongest = F.greatest("_best", "_leader", "_change")
    parent = (
        F.when(F.col("best").isNull() | F.col("leader").isNull() | (F.col("u_reset") < F.lit(reset)), F.lit(None).cast("bigint"))
        .when(F.col("anchor").isNotNull() & (F.col("_anchor") >= strongest), F.col("anchor"))
        .when(F.col("_leader") >= F.greatest("_best", "_change"), F.col("leader"))
        .when(F.col("_best") >= F.col("_change"), F.col("best"))
        .otherwise(F.col("position"))
    )
    return told.select("slot", "child", parent.alias("parent"), "u_seed", "u_operator")


def advanced(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The particles after a round; ``outcomes`` has ``slot, i, fitness, at`` of evaluated children.

    A particle moves to its fittest child of the round, of equal ones that with
    the smallest id, and remembers it when its standing among the round's
    children is above the remembered one.  Children without a finite fitness
    count for nothing; a particle without another child stays as it is.
    """
    good = outcomes.where("fitness IS NOT NULL AND NOT isnan(fitness) AND abs(fitness) <> double('infinity')")
    level = good.agg(F.avg("fitness").alias("_mean"), F.stddev_pop("fitness").alias("_std")).withColumn("_one", F.lit(1))
    scale = F.when(F.col("_std") > 0, F.col("_std")).otherwise(F.lit(1.0))
    fittest = good.groupBy("slot").agg(F.min(F.struct((-F.col("fitness")).alias("f"), "i", "at")).alias("_c")).withColumn("_one", F.lit(1))
    moved = fittest.join(F.broadcast(level), "_one").select("slot", F.col("_c.i").alias("_i"), F.col("_c.at").alias("_at"), ((-F.col("_c.f") - F.col("_mean")) / scale).alias("_z"))
    told = state.join(moved, "slot", "left")
    better = F.col("_z").isNotNull() & (F.col("best_z").isNull() | (F.col("_z") > F.col("best_z")))
    return told.select(
        "slot", F.coalesce("_i", "position").alias("position"), F.coalesce("_at", "position_at").alias("position_at"),
        F.when(better, F.col("_i")).otherwise(F.col("best")).alias("best"), F.when(better, F.col("_at")).otherwise(F.col("best_at")).alias("best_at"),
        F.when(better, F.col("_z")).otherwise(F.col("best_z")).alias("best_z"))


def planned(chosen: DataFrame, seeds: DataFrame, operators: Sequence[str], children: int, start: int) -> DataFrame:
    """``i, parent, operator`` of the chosen targets; ``seeds`` has ``place, seed`` numbered from zero."""
    count = seeds.count()
    place = F.floor(F.col("u_seed") * count).cast("bigint")
    told = chosen.withColumn("place", place).join(seeds, "place", "left")
    named = F.element_at(F.array(*[F.lit(n) for n in operators]), (F.floor(F.col("u_operator") * len(operators)) + 1).cast("int"))
    return told.select((F.lit(start) + F.col("slot") * children + F.col("child")).alias("i"), F.coalesce("parent", "seed").alias("parent"), named.alias("operator"))
