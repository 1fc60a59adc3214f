"""The round loop: plan proposals, judge them as DataFrames, keep the best.

The driver holds ids and counters.  Structures, vectors, genomes and
archives stay in tables; each round's accepted rows are written to the run's
folder, which also makes a run resumable.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ANALYSIS_STALE, LoomError, invalid
from ..functions.descriptors import Descriptor, compute
from ..operators.preprocess import bounded_subset
from ..operators.profile import pooled
from ..session import cut_lineage, shared_folder
from . import breeding, scoring, swarm
from .mutations import CHANGES, Rules, propose

MAX_POOL = 256


@dataclass(frozen=True)
class Budget:
    max_evaluations: int = 10_000
    max_accepted: int = 500
    max_generations: int = 200
    target_novelty: float | None = None
    no_improvement_rounds: int = 10
    discovery_window: int = 10
    min_novel_per_100_evals: float = 1.0


@dataclass(frozen=True)
class Settings:
    optimizer: str = "random"
    objective: dict = field(default_factory=lambda: {"type": "novelty"})
    operators: dict = field(default_factory=lambda: {"atomic_displacement": {}})
    children_per_seed: int = 8
    batch_accept: int = 8
    reuse_accepted_seeds: bool = False
    duplicate_threshold: float = 1e-8
    selection: str = "structure_fps_v1"
    immigrant_fraction: float = 0.15
    pulls: swarm.Pulls = swarm.Pulls()
    breeding: breeding.Breeding = breeding.Breeding()
    screening_policy: str = "keep"
    seed: int = 42


@dataclass
class Round:
    generation: int
    proposed: int
    invalid: int
    evaluations: int
    duplicates: int
    accepted: int
    rejected_by_screen: int
    best_fitness: float | None
    best_novelty: float | None
    unique_novel_environments: int | None
    archived_unique_novel_environments: int | None


# --- parents of a random round -------------------------------------------------


def chosen_parents(seeds: list[int], accepted: list[int], slots: int, rng: np.random.Generator, weights: np.ndarray | None = None) -> list[int]:
    """A parent per slot, none twice while there are others.

    With accepted ones, half the slots are theirs (one at least), and more where
    the seeds are too few; the order is drawn.  Weighted seeds are drawn with
    repeats, as a target may leave few with any weight.
    """
    if weights is not None:
        return [int(s) for s in rng.choice(seeds, slots, p=weights)]
    theirs = min(len(accepted), max(1, slots // 2)) if accepted else 0
    ours = min(len(seeds), slots - theirs)
    theirs += min(slots - theirs - ours, len(accepted) - theirs)
    picked = [int(x) for group, n in ((accepted, theirs), (seeds, ours)) if n for x in rng.choice(group, n, replace=False)]
    return [picked[k] for k in rng.permutation(len(picked))]


# --- the loop ----------------------------------------------------------------


@dataclass
class Expansion:
    """A run: its records, why it stopped, and where its rows are."""

    folder: str
    rounds: list[Round]
    stopped_by: str
    accepted: DataFrame | None


def _stop(budget: Budget, rounds: list[Round], evaluations: int, accepted: int, stagnant: int, screened: bool) -> str | None:
    if evaluations >= budget.max_evaluations:
        return "max_evaluations"
    if accepted >= budget.max_accepted:
        return "max_accepted"
    if len(rounds) >= budget.max_generations:
        return "max_generations"
    if stagnant >= budget.no_improvement_rounds:
        return "no_improvement"
    last = rounds[-budget.discovery_window:] if budget.discovery_window else []
    if last and len(rounds) >= budget.discovery_window and last[-1].unique_novel_environments is not None:
        spent = sum(r.evaluations for r in last)
        floor = budget.min_novel_per_100_evals * spent / 100.0
        if spent and sum(r.unique_novel_environments or 0 for r in last) < floor:
            return "discovery_saturated"
        if screened and spent and sum(r.archived_unique_novel_environments or 0 for r in last) < floor:
            return "screening_bottleneck"
    if rounds and budget.target_novelty is not None and (rounds[-1].best_novelty or 0.0) >= budget.target_novelty:
        return "target_novelty"
    return None


def seed_pool(frames: DataFrame, rows: int, limit: int, anchors: DataFrame | None = None, position: str = "frame_index") -> DataFrame:
    """Evenly spread seeds with anchors put first."""
    picked = bounded_subset(frames, rows, limit, position).withColumn("anchor", F.lit(False))
    if anchors is None:
        return picked
    first = frames.join(anchors.select(position), position, "left_semi").withColumn("anchor", F.lit(True))
    return first.unionByName(picked.join(anchors.select(position), position, "left_anti"))


def _bred(spark, settings: Settings, pool: DataFrame, places: DataFrame, near: np.ndarray, start: int, generation: int, tallies: dict,
          target: tuple[DataFrame, float] | None, archive: scoring.Archive) -> DataFrame:
    """The children of a genetic round; of the pool only its size, or distances to the target, reach the driver."""
    size = pool.count()
    how = settings.breeding
    weights = breeding.rank_weights(size, how)
    beside: list[float] = []
    if target is not None and size >= how.warm_pool:
        anchors, radius = target
        gaps = scoring.seed_distance(pool.select(F.col("rank").alias("i"), F.col("at").alias("features")), archive.scaled(anchors).select("i", "features")) if size else None
        at = {r["i"]: r["distance"] for r in gaps.collect()} if size else {}
        weights = weights * breeding.nearness(np.array([at[k] for k in range(len(weights))]), radius)
        beside = near.tolist()
    factors = None
    if how.weigh_success:
        rows = spark.createDataFrame([(n, *t) for n, t in tallies.items()], "operator string, proposed bigint, accepted bigint")
        factors = {r["operator"]: r["factor"] for r in breeding.success_factors(rows).collect()}
    fresh = breeding.immigrant_slots(len(near), size, settings.immigrant_fraction, how.warm_pool)
    draws = breeding.drawn(spark, len(near), settings.children_per_seed, start, len(settings.operators), settings.seed, generation)
    return breeding.children(draws, pool, places, settings.operators, weights.tolist(), near.tolist(), fresh, how, factors, beside)


def run(
    seeds: DataFrame,
    reference: DataFrame,
    descriptor: Descriptor,
    settings: Settings,
    budget: Budget,
    rules: Rules = Rules(),
    folder: str | None = None,
    target_radius: tuple[DataFrame, float] | None = None,
    screen: Callable[[DataFrame], DataFrame] | None = None,
    resume: bool = False,
) -> Expansion:
    """Expands ``seeds`` (frame rows keyed ``i``) against ``reference`` frames.

    ``screen`` may return ``i, verdict`` with pass, fail or unscreenable for
    accepted candidates; the policy says whether unscreenable ones are kept.
    """
    if set(settings.operators) - set(CHANGES) or not settings.operators:
        raise invalid("unknown or no structure change", known=sorted(CHANGES))
    spec = scoring.check_objective(settings.objective)
    if not 0.0 <= settings.immigrant_fraction <= breeding.MOST_IMMIGRANTS:
        raise invalid("immigrant_fraction must be in [0, 0.9]")
    if settings.optimizer not in ("random", "genetic", "pso"):
        raise invalid("optimizer must be random, genetic or pso")
    spark = seeds.sparkSession
    folder = folder or os.path.join(shared_folder(spark), f"expansion-{os.urandom(8).hex()}")
    local = spec["type"] in ("local_environment_novelty", "composite")

    def vectors(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = cut_lineage(compute(frames.withColumnRenamed("i", "frame_index"), descriptor).withColumnRenamed("frame", "i"))
        return pooled(rows, "i"), rows

    columns = ["i", "numbers", "positions", "cell", "pbc"]
    seeds = cut_lineage(seeds.select(*columns))
    whole, atoms = vectors(reference.select(*columns))
    archive = scoring.Archive.of(cut_lineage(whole))
    local_archive = scoring.Archive.of(atoms.select((F.col("i") * F.lit(1 << 20) + F.col("row")).alias("i"), "features")) if local else None
    ids = sorted(r["i"] for r in seeds.select("i").collect())
    pooling = settings.optimizer == "genetic" or (settings.optimizer == "random" and settings.reuse_accepted_seeds and target_radius is None)
    parent_pool = breeding.newborn(spark) if pooling else None
    limit = min(MAX_POOL, 4 * len(ids))
    near = np.ones(len(ids))
    if target_radius is not None:
        anchors, radius = target_radius
        far = {r["i"]: r["distance"] for r in scoring.seed_distance(archive.scaled(vectors(seeds)[0]).select("i", "features"), archive.scaled(anchors).select("i", "features")).collect()}
        near = breeding.nearness(np.array([far[i] for i in ids]), radius)
        near = near if near.sum() > 0 else np.ones(len(ids))
    particles = swarm.newborn(spark, len(ids)) if settings.optimizer == "pso" else None
    anchor = None
    places = spark.createDataFrame(list(enumerate(ids)), "place bigint, seed bigint")
    if particles is not None:
        if target_radius is not None:
            nearest_seed = min(ids, key=lambda i: (far[i], i))
            at = archive.scaled(vectors(seeds.where(F.col("i") == nearest_seed))[0]).select(F.col("i").alias("anchor"), F.col("features").alias("anchor_at"))
            anchor = cut_lineage(at)
    state = {"rounds": [], "evaluations": 0, "best": None, "stagnant": 0, "next": max(ids) + 1, "tallies": {n: [0, 0] for n in settings.operators}}
    stamp = json.dumps([asdict(settings), asdict(budget), len(ids), hashlib.sha256(json.dumps(ids).encode()).hexdigest(), archive.scaler.rows], default=str, sort_keys=True)
    if resume:
        # One small text table per round; a round that did not finish left none.
        saved = max((json.loads(r["value"]) for r in spark.read.text(f"{folder}/state-*").collect()), key=lambda s: len(s["state"]["rounds"]))
        if saved["stamp"] != stamp:
            raise LoomError(ANALYSIS_STALE, "the saved run was made from other inputs or settings")
        state = saved["state"]
        if pooling and state["rounds"]:
            parent_pool = spark.read.schema(breeding.STATE).parquet(f"{folder}/pool-{len(state['rounds']) - 1}")
        if particles is not None and state["rounds"]:
            particles = spark.read.schema(swarm.STATE).parquet(f"{folder}/swarm-{len(state['rounds']) - 1}")
    rounds = [Round(**r) for r in state["rounds"]]

    def kept(name: str) -> DataFrame | None:
        paths = [f"{folder}/{name}-{r.generation}" for r in rounds if (r.evaluations if name == "evaluated" else r.accepted)]
        return spark.read.parquet(*paths) if paths else None

    while True:
        accepted_count = sum(r.accepted for r in rounds)
        stopped = _stop(budget, rounds, state["evaluations"], accepted_count, state["stagnant"], screen is not None)
        if stopped:
            return Expansion(folder, rounds, stopped, kept("accepted"))
        generation = len(rounds)
        rng = np.random.default_rng([settings.seed, generation])
        count = min(settings.children_per_seed * len(ids), budget.max_evaluations - state["evaluations"])
        start = state["next"]
        state["next"] += count
        earlier = kept("accepted")
        # A particle can be at any candidate that was evaluated; other parents are accepted ones.
        known = earlier if particles is None else kept("evaluated")
        parents = seeds if known is None else seeds.unionByName(known.select(*columns))
        if settings.optimizer == "random":
            # The pool holds at most `limit` parents.
            feedback = [r["i"] for r in parent_pool.orderBy("rank").select("i").collect()] if pooling else []
            slots = chosen_parents(ids, feedback, len(ids), rng, near / near.sum() if target_radius is not None else None)
            mothers = [p for p in slots for _child in range(settings.children_per_seed)][:count]
            plan = [(start + k, p, str(rng.choice(list(settings.operators)))) for k, p in enumerate(mothers)]
            table = spark.createDataFrame(plan, "i bigint, parent bigint, operator string").repartition(max(1, min(count // 32, 1024)))
        elif settings.optimizer == "genetic":
            table = cut_lineage(_bred(spark, settings, parent_pool, places, near, start, generation, state["tallies"], target_radius, archive).where(F.col("i") < start + count))
        else:
            draws = swarm.drawn(particles, settings.children_per_seed, settings.seed, generation)
            toward = swarm.targets(particles, draws, settings.pulls, settings.immigrant_fraction, anchor)
            table = cut_lineage(swarm.planned(toward, places, list(settings.operators), settings.children_per_seed, start).where(F.col("i") < start + count))
        proposed = cut_lineage(propose(table, parents, settings.operators, rules, settings.seed))
        usable = proposed.where("reason IS NULL")
        frames = usable.select(*columns)
        structures, rows = vectors(frames)
        structures = cut_lineage(structures)
        current = archive if earlier is None else archive.with_accepted(kept("structures"))
        current_local = local_archive
        if local and earlier is not None:
            current_local = local_archive.with_accepted(kept("environments"))
        scored = cut_lineage(scoring.reject_duplicates(scoring.score(spec, structures, rows, current, current_local), settings.duplicate_threshold))
        facts = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fitness") == float("-inf")).alias("dup"), F.max("fitness").alias("best"), F.max("novelty").alias("nov")).first()
        room = min(settings.batch_accept, budget.max_accepted - accepted_count)
        best_pool = cut_lineage(scoring.elite(scored, room))
        threshold = spec.get("novelty_threshold")
        if facts["n"]:
            usable.join(scored, "i").withColumn("generation", F.lit(generation)).write.mode("overwrite").parquet(f"{folder}/evaluated-{generation}")
        if settings.selection == "local_incremental_maximin_v1" and local and threshold is not None:
            chosen = scoring.select_by_environments(best_pool, structures, rows, current_local, threshold, room)
        else:
            chosen = scoring.select_spread(best_pool, structures, room)
        picked = spark.createDataFrame([(c,) for c in chosen], "i bigint")
        unique = archived = None
        if local and threshold is not None:
            mine = rows.join(F.broadcast(picked), "i", "left_semi")
            unique = archived = scoring.unique_environments(mine, current_local, threshold, chosen)
        dropped, refused = 0, []
        if screen is not None and chosen:
            verdicts = {r["i"]: r["verdict"] for r in screen(frames.join(F.broadcast(picked), "i", "left_semi")).collect()}
            passed = [c for c in chosen if verdicts.get(c) == "pass" or (verdicts.get(c, "unscreenable") == "unscreenable" and settings.screening_policy == "keep")]
            refused = [c for c in chosen if c not in set(passed)]
            dropped, chosen = len(refused), passed
            picked = spark.createDataFrame([(c,) for c in chosen], "i bigint")
            if unique is not None:
                archived = scoring.unique_environments(rows.join(F.broadcast(picked), "i", "left_semi"), current_local, threshold, chosen)
        if chosen:
            members = F.broadcast(picked)
            out = usable.join(members, "i", "left_semi").join(scored, "i").withColumn("generation", F.lit(generation))
            out.write.mode("overwrite").parquet(f"{folder}/accepted-{generation}")
            archive.scaled(structures.join(members, "i", "left_semi")).select("i", "features").write.mode("overwrite").parquet(f"{folder}/structures-{generation}")
            if local:
                keyed = rows.join(members, "i", "left_semi").select((F.col("i") * F.lit(1 << 20) + F.col("row")).alias("i"), "features")
                local_archive.scaled(keyed).write.mode("overwrite").parquet(f"{folder}/environments-{generation}")
        if pooling:
            order = spark.createDataFrame([(c, k) for k, c in enumerate(chosen)], "i bigint, place bigint")
            nothing = F.lit(None).cast("array<double>")
            genomes = table.select("i", *([F.col("genes"), F.col("shares")] if "genes" in table.columns else [nothing.alias("genes"), nothing.alias("shares")]))
            arrived = archive.scaled(structures).select("i", F.col("features").alias("at")).join(F.broadcast(order), "i").join(genomes, "i")
            breeding.renewed(parent_pool, arrived, limit).write.mode("overwrite").parquet(f"{folder}/pool-{generation}")
            parent_pool = spark.read.schema(breeding.STATE).parquet(f"{folder}/pool-{generation}")
        if settings.optimizer == "genetic":
            for r in proposed.join(F.broadcast(picked.withColumn("_in", F.lit(1))), "i", "left").groupBy("operator").agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("k")).collect():
                had = state["tallies"].setdefault(r["operator"], [0, 0])
                state["tallies"][r["operator"]] = [had[0] + r["n"], had[1] + r["k"]]
        if particles is not None:
            slot = F.floor((F.col("i") - start) / settings.children_per_seed)
            told_all = scored.where(~F.col("i").isin(refused)) if refused else scored
            outcomes = told_all.select("i", "fitness").join(archive.scaled(structures).select("i", F.col("features").alias("at")), "i").withColumn("slot", slot)
            swarm.advanced(particles, outcomes).write.mode("overwrite").parquet(f"{folder}/swarm-{generation}")
            particles = spark.read.schema(swarm.STATE).parquet(f"{folder}/swarm-{generation}")
        state["evaluations"] += facts["n"]
        best = facts["best"] if facts["n"] and facts["best"] != float("-inf") else None
        improved = best is not None and (state["best"] is None or best > state["best"] + 1e-9)
        state["best"] = best if improved else state["best"]
        state["stagnant"] = 0 if improved else state["stagnant"] + 1
        rounds.append(Round(generation, count, count - facts["n"], facts["n"], facts["dup"] or 0, len(chosen), dropped, best, facts["nov"], unique, archived))
        if not facts["n"]:
            # Every proposal broke a rule; count the attempt so the run ends.
            state["evaluations"] += count
        state["rounds"] = [asdict(r) for r in rounds]
        body = json.dumps({"stamp": stamp, "state": state})
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/state-{generation}")


def catalog() -> dict:
    """The vocabulary with its defaults."""
    return {"optimizers": ["random", "genetic", "pso"], "objectives": scoring.OBJECTIVES, "operators": sorted(CHANGES),
            "constraints": asdict(Rules()), "budget": asdict(Budget()), "selection": ["structure_fps_v1", "local_incremental_maximin_v1"]}
