"""How faithfully a descriptor reflects structures.

Checks that recompute a descriptor are narrow: each frame row carries all it
needs, so transforms and finite differences run where the frame lies.  Checks
that compare frames are joins on the neighbour table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions.descriptors import Descriptor, frame_vector
from ..functions.vec import euclidean
from ..params import float_param, int_param, seed_param
from .contacts import _by_frame
from .correlation import guarded
from .neighbors import exploded, self_nearest
from .ordering import exact_quantiles, quantile_values, running_totals
from .spectrum import bounded_rows

# --- fingerprints ------------------------------------------------------------


def nearest_images(gaps: np.ndarray, box: np.ndarray, pbc: np.ndarray) -> np.ndarray:
    if not pbc.any() or abs(np.linalg.det(box)) < 1e-12:
        return gaps
    return gaps - np.where(pbc, np.rint(gaps @ np.linalg.inv(box)), 0.0) @ box


def structure_fingerprints(frames: DataFrame) -> DataFrame:
    """``frame, atoms, shape``: sorted pair distances of each frame."""

    def kernel(index, numbers, xyz, box, pbc):
        a, b = np.triu_indices(len(xyz), 1)
        d = np.sort(np.linalg.norm(nearest_images(xyz[a] - xyz[b], box, pbc), axis=1))
        return np.array([index]), np.array([len(numbers)]), [d.tolist()]

    return _by_frame(frames, kernel, "frame bigint, atoms bigint, shape array<double>")


def environment_fingerprints(frames: DataFrame, cutoff: float, neighbors: int) -> DataFrame:
    """``frame, row, element, shape, species``: padded neighbour distances and kinds."""

    def kernel(index, numbers, xyz, box, pbc):
        shapes, species = [], []
        for k in range(len(xyz)):
            d = np.linalg.norm(nearest_images(xyz - xyz[k], box, pbc), axis=1)
            near = (d <= cutoff) & (np.arange(len(xyz)) != k)
            shape, kinds = np.sort(d[near])[:neighbors], np.sort(numbers[near])[:neighbors]
            shapes.append(np.pad(shape, (0, neighbors - len(shape))).tolist())
            species.append(np.pad(kinds, (0, neighbors - len(kinds))).astype(int).tolist())
        n = len(xyz)
        return np.full(n, index), np.arange(n, dtype=np.int32), numbers.astype(np.int32), shapes, species

    return _by_frame(frames, kernel, "frame bigint, row int, element int, shape array<double>, species array<bigint>")


def structural_gap(left: str = "a", right: str = "b"):
    """Distance of two fingerprints; infinite between different atom counts."""
    x, y = F.col(f"{left}_shape"), F.col(f"{right}_shape")
    return F.when(F.size(x) == F.size(y), euclidean(x, y)).otherwise(F.lit(float("inf")))


def _with_structure(pairs: DataFrame, shapes: DataFrame, energy: DataFrame | None) -> DataFrame:
    for side in ("a", "b"):
        facts = shapes.select(F.col("frame").alias(side), F.col("shape").alias(f"{side}_shape"))
        if energy is not None:
            facts = facts.join(energy.select(F.col("frame").alias(side), F.col("energy").alias(f"{side}_energy")), side, "left")
        pairs = pairs.join(facts, side)
    gap = F.abs(F.col("a_energy") - F.col("b_energy")) if energy is not None else F.lit(None).cast("double")
    return pairs.select("a", "b", "distance", structural_gap().alias("structural"), gap.alias("delta_energy"))


# --- comparisons -------------------------------------------------------------


def degeneracy_search(df: DataFrame, shapes: DataFrame, energy: DataFrame | None = None, params: dict | None = None) -> dict:
    """Neighbours in the descriptor that differ in structure or energy."""
    params = params or {}
    k = int_param(params, "k_neighbors", 8)
    close_q = float_param(params, "d_quantile", 0.05, 0.0, 1.0)
    far_q = float_param(params, "structure_quantile", 0.9, 0.5, 1.0)
    energy_q = float_param(params, "energy_quantile", 0.9, 0.5, 1.0)
    shown = int_param(params, "max_pairs", 50)
    edges = exploded(self_nearest(df, k))
    pairs = edges.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("distance").alias("distance"))
    table = _with_structure(pairs, shapes, energy).persist()
    close = quantile_values(table, "distance", [close_q])[0]
    finite = table.where(F.col("structural") < float("inf"))
    far = quantile_values(finite, "structural", [far_q])[0]
    if close is None or far is None:
        raise invalid("not enough candidate pairs to set degeneracy thresholds")
    jump = quantile_values(table.where("delta_energy IS NOT NULL"), "delta_energy", [energy_q])[0] if energy is not None else None
    by_shape = F.col("structural") >= far
    by_energy = F.coalesce(F.col("delta_energy") >= F.lit(jump), F.lit(False)) if jump is not None else F.lit(False)
    reason = (
        F.when(by_shape & by_energy, "structure+energy")
        .when(by_shape, F.when(F.col("structural") < float("inf"), "structure").otherwise("atom_count"))
        .otherwise("energy"))
    severity = F.when(F.col("structural") < float("inf"), F.col("structural") / F.greatest(F.col("distance"), F.lit(1e-12))).otherwise(F.lit(float("inf")))
    hits = table.where((F.col("distance") <= close) & (by_shape | by_energy)).withColumn("reason", reason).withColumn("severity", severity)
    return {
        "pairs": table, "dangerous": hits, "shown": hits.orderBy(F.desc("severity"), "a", "b").limit(shown),
        "thresholds": {"descriptor": close, "structural": far, "energy": jump},
    }


def distance_consistency(df: DataFrame, shapes: DataFrame, energy: DataFrame | None = None, params: dict | None = None) -> dict:
    """Descriptor distance against structural distance, over an evenly spread subset.

    The caller gives the subset's size, as the pair table is its square; partners
    come from a list of the subset's ids, rows from equi-joins.
    """
    params = params or {}
    bins = int_param(params, "n_bins", 12, 4, 32)
    low_q = float_param(params, "d_quantile", 0.05, 1e-9, 0.5)
    high_q = float_param(params, "structure_quantile", 0.95, 0.5, 1.0)
    subset = bounded_rows(df.select("i", "features"), int_param(params, "max_samples", 128, 3)).persist()
    ids = sorted(r["i"] for r in subset.select("i").collect())
    later = F.array(*[F.lit(i) for i in ids])
    pairs = subset.select(F.col("i").alias("a"), F.col("features").alias("u"), F.explode(F.filter(later, lambda j: j > F.col("i"))).alias("b"))
    pairs = pairs.join(subset.select(F.col("i").alias("b"), F.col("features").alias("w")), "b")
    table = _with_structure(pairs.select("a", "b", euclidean(F.col("u"), F.col("w")).alias("distance")), shapes, energy)
    table = table.where(F.col("structural") < float("inf")).persist()
    edges = quantile_values(table, "distance", [k / bins for k in range(bins + 1)])
    slot = F.lit(0)
    for edge in edges[1:-1]:
        slot = slot + (F.col("distance") >= F.lit(edge)).cast("int")
    binned = table.withColumn("bin", slot)
    base = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d_max"), F.avg("structural").alias("mean"))
    middle = exact_quantiles(binned, ["bin"], "structural", [0.5, 0.9], ["median", "p90"])
    close, = quantile_values(table, "distance", [low_q])
    far, = quantile_values(table, "structural", [high_q])
    collapsed = table.agg(F.count_if((F.col("distance") <= close) & (F.col("structural") >= far)).alias("n"), F.count(F.lit(1)).alias("all")).first()
    expected = low_q * (1.0 - high_q)
    share = collapsed["n"] / max(len(ids) * (len(ids) - 1) // 2, 1)
    # Ordinal ranks, ties in pair order.
    places = table.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    ranked = running_totals(places.withColumn("_x", F.struct("distance", "a", "b")), ["_all"], "_x", "_one", 1).withColumnRenamed("before", "rx").drop("total")
    ranked = running_totals(ranked.withColumn("_y", F.struct("structural", "a", "b")), ["_all"], "_y", "_one", 1).withColumnRenamed("before", "ry")
    stats = ranked.agg(guarded("distance", "structural").alias("pearson"), guarded("rx", "ry").alias("spearman")).first()
    return {"pairs": table, "bins": base.join(middle, "bin"), "pearson": stats["pearson"], "spearman": stats["spearman"],
            "collapse_count": collapsed["n"], "collapse_fraction": share, "enrichment": share / expected if expected else None,
            "d_threshold": close, "structural_threshold": far}


# --- recomputation -----------------------------------------------------------


def rotation(rng: np.random.Generator) -> np.ndarray:
    """A uniformly random proper rotation."""
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q * np.array([-1.0, 1.0, 1.0])


def reflection(rng: np.random.Generator) -> np.ndarray:
    """A mirror through the origin across a random plane."""
    normal = rng.normal(size=3)
    normal = normal / max(np.linalg.norm(normal), 1e-12)
    return np.eye(3) - 2.0 * np.outer(normal, normal)


def _relative(changed: np.ndarray, base: np.ndarray) -> float:
    return float(np.linalg.norm(changed - base) / max(np.linalg.norm(base), 1e-12))


def formal_invariance(frames: DataFrame, descriptor: Descriptor, params: dict | None = None) -> DataFrame:
    """Relative change of each frame's vector under operations that should not matter.

    ``reflection`` is reported but is not a fault: a descriptor may see chirality.
    """
    params = params or {}
    turns, seed = int_param(params, "n_rotations", 4, 1, 16), seed_param(params)
    limit = float_param(params, "tolerance", 1e-6, 0.0)

    def kernel(index, numbers, xyz, box, pbc):
        rng = np.random.default_rng([seed, index & 0x7FFFFFFF])
        base = frame_vector(descriptor, numbers, xyz, box, pbc)

        def after(z=numbers, p=xyz, c=box):
            return _relative(frame_vector(descriptor, z, p, c, pbc), base)

        moved = after(p=xyz + rng.normal(size=3))
        turned = max(after(p=xyz @ r.T, c=box @ r.T) for r in (rotation(rng) for _ in range(turns)))
        mirror = reflection(rng)
        mirrored = after(p=xyz @ mirror.T, c=box @ mirror.T)
        order = rng.permutation(len(numbers))
        shuffled = after(z=numbers[order], p=xyz[order])
        single = after(p=xyz.astype(np.float32).astype(float), c=box.astype(np.float32).astype(float))
        return tuple(np.array([v]) for v in (index, moved, turned, mirrored, shuffled, single))

    out = _by_frame(frames, kernel, "frame bigint, translation double, rotation double, reflection double, permutation double, precision double")
    passed = (F.col("translation") <= limit) & (F.col("rotation") <= limit) & (F.col("permutation") <= limit)
    return out.withColumn("passed", passed).withColumn("sees_chirality", F.col("reflection") > limit)


def perturbation_response(frames: DataFrame, descriptor: Descriptor, params: dict | None = None) -> DataFrame:
    """``frame, amplitude, response`` to random jitter or strain of growing size."""
    params = params or {}
    kind = str(params.get("perturbation") or "jitter")
    amplitudes = [float(a) for a in params.get("amplitudes", (0.01, 0.02, 0.05, 0.1))]
    if kind not in ("jitter", "strain") or not 2 <= len(amplitudes) <= 32 or min(amplitudes) <= 0:
        raise invalid("perturbation needs jitter or strain and 2 to 32 positive amplitudes")
    seed = seed_param(params)

    def kernel(index, numbers, xyz, box, pbc):
        base = frame_vector(descriptor, numbers, xyz, box, pbc)
        out = []
        for k, size in enumerate(amplitudes):
            rng = np.random.default_rng([seed, index & 0x7FFFFFFF, k])
            if kind == "jitter":
                p, c = xyz + rng.normal(scale=size, size=xyz.shape), box
            else:
                stretch = rng.uniform(-size, size, size=(3, 3))
                warp = np.eye(3) + 0.5 * (stretch + stretch.T)
                p, c = xyz @ warp, box @ warp
            out.append(_relative(frame_vector(descriptor, numbers, p, c, pbc), base))
        return np.full(len(out), index), np.array(amplitudes), np.array(out)

    return _by_frame(frames, kernel, "frame bigint, amplitude double, response double")


def response_summary(responses: DataFrame) -> DataFrame:
    base = responses.groupBy("amplitude").agg(F.avg("response").alias("mean"), F.max("response").alias("max"))
    middle = exact_quantiles(responses, ["amplitude"], "response", [0.5, 0.95], ["median", "p95"])
    return base.join(middle, "amplitude")


def cutoff_smoothness(frames: DataFrame, at_offset: Callable[[float], Descriptor], params: dict | None = None) -> DataFrame:
    """Response of each frame as the cutoff is moved; a jump near zero is flagged.

    The row at offset zero, the true middle of the scan, is the reference.
    """
    params = params or {}
    span = float_param(params, "max_delta", 0.1, 1e-9, 5.0)
    steps = int_param(params, "n_steps", 9, 5, 41)
    limit = float_param(params, "jump_threshold", 3.0, 1.0)
    if steps % 2 == 0:
        raise invalid("n_steps must be odd")
    offsets = np.linspace(-span, span, steps)
    middle = steps // 2

    def kernel(index, numbers, xyz, box, pbc):
        rows = np.stack([frame_vector(at_offset(float(o)), numbers, xyz, box, pbc) for o in offsets])
        scale = max(float(np.linalg.norm(rows[middle])), 1e-12)
        slope = np.gradient(rows, offsets, axis=0)
        bend = np.gradient(slope, offsets, axis=0)
        moves = np.linalg.norm(np.diff(rows, axis=0), axis=1) / scale
        near = moves[[middle - 1, middle]].max()
        rest = np.delete(moves, [middle - 1, middle])
        worst = float((np.linalg.norm(rows - rows[middle], axis=1) / scale).max())
        return tuple(np.array([v]) for v in (
            index, float(near / max(rest.mean(), 1e-15)), worst,
            float(np.linalg.norm(slope, axis=1).max()), float(np.linalg.norm(bend, axis=1).max())))

    out = _by_frame(frames, kernel, "frame bigint, jump_ratio double, worst_response double, max_slope double, max_bend double")
    return out.withColumn("flagged", F.col("jump_ratio") > limit)


def frame_jacobian(frames: DataFrame, descriptor: Descriptor, params: dict | None = None) -> DataFrame:
    """Rank of the descriptor's response to moving atoms, and its blindness to turns.

    A vector per frame cannot see more directions than atoms can move in once
    shifts are set aside: 3n - 3.
    """
    params = params or {}
    step = float_param(params, "step", 1e-3, 1e-6, 0.1)
    share = float_param(params, "rank_tolerance", 1e-6, 0.0, 1.0)

    def kernel(index, numbers, xyz, box, pbc):
        def vector(p):
            return np.atleast_2d(descriptor(numbers, p, box, pbc)).reshape(-1)

        columns = []
        for k in range(xyz.size):
            nudge = np.zeros(xyz.size)
            nudge[k] = step
            nudge = nudge.reshape(xyz.shape)
            columns.append((vector(xyz + nudge) - vector(xyz - nudge)) / (2 * step))
        slope = np.stack(columns, axis=1)
        values = np.linalg.svd(slope, compute_uv=False)
        rank = int((values > share * max(float(values[0]) if len(values) else 0.0, 1e-300)).sum()) if values.size and values[0] > 0 else 0
        middle = xyz - xyz.mean(axis=0)
        turns = np.stack([np.cross(axis, middle).reshape(-1) for axis in np.eye(3)], axis=1)
        left = float(np.linalg.norm(slope @ turns) / max(np.linalg.norm(slope) * np.linalg.norm(turns), 1e-300))
        full = max(xyz.size - 3, 0)
        return tuple(np.array([v]) for v in (index, rank, full, max(full - rank, 0), left))

    return _by_frame(frames, kernel, "frame bigint, rank bigint, full_rank bigint, deficiency bigint, rotation_residual double")


def run_sensitivity(runs: dict[str, DataFrame], params: dict | None = None) -> list[dict]:
    """Each run's spread and its geometry against the first run's."""
    from .crossset import compare, require_aligned
    from .spectrum import effective_dimension

    if len(runs) < 2:
        raise invalid("sensitivity needs at least two runs")
    first_name, first = next(iter(runs.items()))
    out = []
    for name, run in runs.items():
        record = {"run": name, "rows": require_aligned(first, run), "effective_dimension": effective_dimension(run)["participation_ratio"]}
        if name != first_name:
            record.update({k: v for k, v in compare(first, run, params).items() if k not in ("left_effective_dimension", "right_effective_dimension")})
        out.append(record)
    return out
