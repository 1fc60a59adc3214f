"""What a candidate is worth, and which candidates to keep."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import ints, matrix
from ..errors import invalid
from ..operators import preprocess
from ..operators.neighbors import broadcast_reduce, nearest, pair_distances
from ..params import choice, float_param

# The parameters each objective understands.
OBJECTIVES = {
    "novelty": (),
    "local_environment_novelty": ("aggregation", "top_fraction", "quantile", "novelty_threshold"),
    "composite": ("structure_weight", "local_weight", "aggregation", "top_fraction", "quantile", "novelty_threshold"),
    "coverage": (),
}
AGGREGATIONS = ("mean", "top_fraction_mean", "quantile", "max")


def check_objective(spec: dict) -> dict:
    """The objective with its parameters, refusing unknown names and bad ranges."""
    kind = choice(spec, "type", "novelty", tuple(OBJECTIVES))
    unknown = set(spec) - {"type"} - set(OBJECTIVES[kind])
    if unknown:
        raise invalid(f"unknown parameters for {kind}: {sorted(unknown)}")
    out = {"type": kind}
    if "aggregation" in OBJECTIVES[kind]:
        out["aggregation"] = choice(spec, "aggregation", "top_fraction_mean", AGGREGATIONS)
        out["top_fraction"] = float_param(spec, "top_fraction", 0.2, 1e-9, 1.0)
        out["quantile"] = float_param(spec, "quantile", 0.5, 1e-9, 1.0)
        threshold = spec.get("novelty_threshold", 0.25)
        out["novelty_threshold"] = None if threshold is None else float_param(spec, "novelty_threshold", 0.25, 0.0)
    if kind == "composite":
        out["structure_weight"] = float_param(spec, "structure_weight", 0.3, 0.0)
        out["local_weight"] = float_param(spec, "local_weight", 0.7, 0.0)
    return out


@dataclass
class Archive:
    """A frozen scaled reference and what has been accepted since."""

    scaler: preprocess.Scaler
    reference: DataFrame
    accepted: DataFrame | None = None

    @classmethod
    def of(cls, reference: DataFrame, scaling: str = "standardized") -> Archive:
        scaler = preprocess.fit_sampling(reference, scaling)
        return cls(scaler, scaler.apply(reference).select("i", "features"))

    def scaled(self, df: DataFrame) -> DataFrame:
        return self.scaler.apply(df)

    def nearest(self, raw: DataFrame) -> DataFrame:
        """``i, distance`` to the closest archived vector."""
        rows = self.scaled(raw).select("i", "features")
        found = nearest(self.reference, rows, 1).select("i", F.col("distances")[0].alias("distance"))
        if self.accepted is None:
            return found
        own = nearest(self.accepted, rows, 1).select("i", F.col("distances")[0].alias("other"))
        return found.join(own, "i").select("i", F.least("distance", "other").alias("distance"))

    def with_accepted(self, scaled_rows: DataFrame) -> Archive:
        return Archive(self.scaler, self.reference, scaled_rows)

    def coverage_radius(self) -> float | None:
        """Farthest reference row from what has been accepted."""
        if self.accepted is None:
            return None
        return nearest(self.accepted, self.reference, 1).agg(F.max(F.col("distances")[0])).first()[0]


# --- objectives --------------------------------------------------------------


def _per_candidate(distances: DataFrame, spec: dict) -> DataFrame:
    """``i, local, novel, atoms`` from per-atom distances.

    A candidate's atoms are few and its row count is part of the structure, so
    ranking inside a candidate is a bounded window.
    """
    how = spec["aggregation"]
    if how == "mean":
        value = F.avg("distance")
    elif how == "max":
        value = F.max("distance")
    elif how == "quantile":
        value = F.percentile("distance", F.lit(spec["quantile"]))
    else:
        place = Window.partitionBy("i").orderBy(F.desc("distance"))
        size = F.count(F.lit(1)).over(Window.partitionBy("i"))
        top = F.greatest(F.lit(1), F.ceil(F.lit(spec["top_fraction"]) * size))
        distances = distances.withColumn("_top", F.when(F.row_number().over(place) <= top, F.col("distance")))
        value = F.avg("_top")
    threshold = spec.get("novelty_threshold")
    novel = F.count_if(F.col("distance") > F.lit(threshold)) if threshold is not None else F.lit(None).cast("bigint")
    return distances.groupBy("i").agg(value.alias("local"), novel.alias("novel"), F.count(F.lit(1)).alias("atoms"))


def coverage_gain(archive: Archive, rows: DataFrame) -> DataFrame:
    """``i, gain``: how much each scaled candidate would shrink the covering radius.

    Each block of reference rows reduces to one number per candidate, then
    blocks combine by maximum; no reference-candidate pairs are listed.
    """
    if rows.isEmpty():
        return rows.select("i", F.lit(0.0).alias("gain"))
    if archive.accepted is None:
        base = archive.reference.select("i", "features", F.lit(float("inf")).alias("now"))
    else:
        base = nearest(archive.accepted, archive.reference, 1).select("i", F.col("distances")[0].alias("now")).join(archive.reference, "i")
    radius = base.agg(F.max("now")).first()[0]
    # The current distance rides along as a last coordinate of the query row.
    query = base.select("i", F.concat("features", F.array("now")).alias("features"))

    def left(q_ids, q, _qt, r_ids, r, _rt):
        gap = pair_distances(q[:, :-1], r, "euclidean")
        return r_ids, np.minimum(gap, q[:, -1:]).max(axis=0)

    best = broadcast_reduce(
        rows.select("i", "features", F.lit(0).cast("bigint").alias("tag")), query, left, "i bigint, radius double",
        lambda parts: parts.groupBy("i").agg(F.max("radius").alias("radius")))
    gain = -F.col("radius") if radius == float("inf") else F.greatest(F.lit(radius) - F.col("radius"), F.lit(0.0))
    return best.select("i", gain.alias("gain"))


def score(spec: dict, structures: DataFrame, atoms: DataFrame | None, structure_archive: Archive, local_archive: Archive | None) -> DataFrame:
    """``i, fitness, novelty, local, novel`` of every candidate.

    ``structures`` has ``i, features``; ``atoms`` has ``i, row, features``.
    """
    kind = spec["type"]
    base = structure_archive.nearest(structures).select("i", F.col("distance").alias("novelty"))
    if kind == "novelty":
        return base.select("i", F.col("novelty").alias("fitness"), "novelty", F.lit(None).cast("double").alias("local"), F.lit(None).cast("bigint").alias("novel"))
    if kind == "coverage":
        gain = coverage_gain(structure_archive, structure_archive.scaled(structures))
        return base.join(gain, "i").select("i", F.col("gain").alias("fitness"), "novelty", F.lit(None).cast("double").alias("local"), F.lit(None).cast("bigint").alias("novel"))
    if atoms is None or local_archive is None:
        raise invalid(f"{kind} needs atom rows and a local archive")
    keyed = atoms.select((F.col("i") * F.lit(1 << 20) + F.col("row")).alias("k"), F.col("i").alias("owner"), "features")
    found = local_archive.nearest(keyed.select(F.col("k").alias("i"), "features")).select(F.col("i").alias("k"), "distance")
    local = _per_candidate(keyed.select("k", "owner").join(found, "k").select(F.col("owner").alias("i"), "distance"), spec)
    joined = base.join(local, "i", "left")
    worth = F.coalesce("local", F.lit(0.0))
    if kind == "composite":
        worth = F.lit(spec["structure_weight"]) * F.col("novelty") + F.lit(spec["local_weight"]) * worth
    return joined.select("i", worth.alias("fitness"), "novelty", "local", "novel")


def reject_duplicates(scored: DataFrame, threshold: float) -> DataFrame:
    """Candidates closer than the threshold to the archive cannot be chosen."""
    return scored.withColumn("fitness", F.when(F.col("novelty") < threshold, F.lit(float("-inf"))).otherwise(F.col("fitness")))


# --- counting and selection --------------------------------------------------


def _fresh_rows(rows: np.ndarray, known: np.ndarray, threshold: float) -> np.ndarray:
    """Greedy: rows farther than the threshold from known rows and each other."""
    kept = known
    for row in rows:
        if not len(kept) or pair_distances(row[None, :], kept, "euclidean").min() > threshold:
            kept = np.vstack([kept, row]) if len(kept) else row[None, :]
    return kept[len(known):]


def _novel_atoms(selected: DataFrame, archive: Archive, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, row and scaled vector of atoms far from the archive."""
    keyed = selected.select((F.col("i") * F.lit(1 << 20) + F.col("row")).alias("i"), "features")
    far = archive.nearest(keyed).where(F.col("distance") > threshold).select("i")
    rows = archive.scaled(keyed).join(far, "i").toArrow()
    keys = ints(rows.column("i").combine_chunks())
    order = np.argsort(keys)
    return keys[order] >> 20, keys[order] & ((1 << 20) - 1), matrix(rows.column("features"))[order] if len(order) else np.zeros((0, 0))


def unique_environments(selected: DataFrame, archive: Archive, threshold: float, order: list[int], canonical: bool = True) -> int:
    """Distinct new environments among the accepted structures' atoms.

    Canonical order (by id, then lexicographic rows) makes the greedy count
    independent of arrival.  Only atoms already found far from the archive by
    the distributed search reach the driver, for one accepted batch.
    """
    owner, _row, rows = _novel_atoms(selected, archive, threshold)
    if not len(owner):
        return 0
    known = np.zeros((0, rows.shape[1]))
    for who in (sorted(set(owner.tolist())) if canonical else [o for o in order if o in set(owner.tolist())]):
        mine = rows[owner == who]
        if canonical:
            mine = mine[np.lexsort(mine.T[::-1])]
        known = np.vstack([known, _fresh_rows(mine, known, threshold)])
    return len(known)


ELITE_FACTOR = 4


def elite(scored: DataFrame, budget: int, factor: int = ELITE_FACTOR) -> DataFrame:
    """The best candidates by fitness; ties prefer the later one."""
    usable = scored.where(F.col("fitness") > F.lit(float("-inf")))
    return usable.orderBy(F.desc("fitness"), F.desc("i")).limit(max(budget * factor, budget))


def select_spread(pool: DataFrame, structures: DataFrame, budget: int) -> list[int]:
    """Farthest points inside the elite pool, starting at its centre."""
    rows = pool.select("i", "fitness").join(structures.select("i", "features"), "i").toArrow()
    if not rows.num_rows:
        return []
    ids, fitness, points = ints(rows.column("i").combine_chunks()), ints(rows.column("fitness").combine_chunks()), matrix(rows.column("features"))
    order = np.lexsort((-ids, -fitness))
    ids, points = ids[order], points[order]
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    chosen, gap = [start], pair_distances(points, points[[start]], "euclidean")[:, 0]
    gap[start] = -1.0
    while len(chosen) < min(budget, len(ids)):
        best = int(gap.argmax())
        chosen.append(best)
        gap = np.where(gap < 0, gap, np.minimum(gap, pair_distances(points, points[[best]], "euclidean")[:, 0]))
        gap[best] = -1.0
    return [int(ids[c]) for c in chosen]


def select_by_environments(pool: DataFrame, structures: DataFrame, atoms: DataFrame, archive: Archive, threshold: float, budget: int) -> list[int]:
    """Each pick adds the most new environments; ties go to the farthest structure."""
    rows = pool.select("i", "fitness").join(structures.select("i", "features"), "i").toArrow()
    if not rows.num_rows:
        return []
    ids, fitness, points = ints(rows.column("i").combine_chunks()), ints(rows.column("fitness").combine_chunks()), matrix(rows.column("features"))
    order = np.lexsort((-ids, -fitness))
    ids, points = ids[order], points[order]
    owner, _row, novel = _novel_atoms(atoms.join(pool.select("i"), "i", "left_semi"), archive, threshold)
    width = novel.shape[1] if len(owner) else 1
    # What each structure would still add; a pick only takes away from the others' lists.
    fresh = {k: _fresh_rows(novel[owner == ids[k]], np.zeros((0, width)), threshold) if len(owner) else np.zeros((0, width)) for k in range(len(ids))}
    apart = np.zeros(len(ids))
    chosen: list[int] = []
    while fresh and len(chosen) < budget:
        best = max(fresh, key=lambda k: (len(fresh[k]), apart[k], -k))
        added = fresh.pop(best)
        to_best = pair_distances(points, points[[best]], "euclidean")[:, 0]
        apart = np.minimum(apart, to_best) if chosen else to_best
        fresh = {k: _fresh_rows(rows, added, threshold) for k, rows in fresh.items()}
        chosen.append(best)
    return [int(ids[c]) for c in chosen]


def seed_distance(seeds: DataFrame, anchors: DataFrame) -> DataFrame:
    """``i, distance`` from each seed structure to the nearest anchor."""
    return nearest(anchors, seeds, 1).select("i", F.col("distances")[0].alias("distance"))


def anchor_rows(atoms: DataFrame, anchor_frames: DataFrame, elements: list[int] | None = None) -> DataFrame:
    """Atom rows of the anchor frames, optionally of given elements."""
    rows = atoms.join(anchor_frames.select("frame"), "frame", "left_semi")
    return rows if not elements else rows.where(F.col("element").isin(elements))


__all__ = [
    "Archive", "anchor_rows", "check_objective", "coverage_gain", "elite", "reject_duplicates", "score", "seed_distance",
    "select_by_environments", "select_spread", "unique_environments",
]
