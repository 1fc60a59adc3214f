"""Structure changes and the geometry rules a changed structure must keep.

Each change is a small function of one frame's arrays and a random stream that
depends only on (seed, candidate number), so a retried task proposes the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions.elements import NUMBERS, RADII
from ..operators.contacts import close_pairs, prepared, stencil


@dataclass
class Atoms:
    numbers: np.ndarray
    xyz: np.ndarray
    box: np.ndarray
    pbc: np.ndarray
    note: dict = field(default_factory=dict)


Change = Callable[[Atoms, np.random.Generator, dict], Atoms | None]


def _bounded(params: dict, name: str, default: float, top: float) -> float:
    value = float(params.get(name, default))
    if not 0.0 < value <= top:
        raise invalid(f"{name} must be in (0, {top}]")
    return value


def displace(a: Atoms, rng: np.random.Generator, params: dict) -> Atoms:
    """Gaussian moves with a random width, optionally capped in length."""
    sigma = _bounded(params, "max_sigma", 0.15, 5.0) * rng.uniform(0.05, 1.0)
    move = rng.normal(0.0, sigma, a.xyz.shape)
    length = np.linalg.norm(move, axis=1)
    if params.get("hard_cutoff") is not None:
        cap = _bounded(params, "hard_cutoff", 1.0, 20.0)
        move *= np.minimum(1.0, cap / np.maximum(length, 1e-300))[:, None]
        length = np.minimum(length, cap)
    return Atoms(a.numbers, a.xyz + move, a.box, a.pbc, {"displacement": float(length.max(initial=0.0))})


def _warp(a: Atoms, matrix: np.ndarray) -> Atoms:
    return Atoms(a.numbers, a.xyz @ matrix, a.box @ matrix, a.pbc, {"volume_change": float(np.linalg.det(matrix) - 1.0)})


def strain_evenly(a: Atoms, rng: np.random.Generator, params: dict) -> Atoms:
    top = _bounded(params, "max_strain", 0.05, 0.5)
    return _warp(a, np.eye(3) * (1.0 + rng.uniform(-top, top)))


def strain_by_axis(a: Atoms, rng: np.random.Generator, params: dict) -> Atoms:
    top = _bounded(params, "max_strain", 0.05, 0.5)
    return _warp(a, np.diag(1.0 + rng.uniform(-top, top, 3)))


def shear(a: Atoms, rng: np.random.Generator, params: dict) -> Atoms:
    top = _bounded(params, "max_shear", 0.05, 0.5)
    matrix = np.eye(3)
    matrix[~np.eye(3, dtype=bool)] = rng.uniform(-top, top, 6)
    return _warp(a, matrix)


def remove_atom(a: Atoms, rng: np.random.Generator, params: dict) -> Atoms | None:
    if len(a.numbers) < 2:
        return None
    keep = np.arange(len(a.numbers)) != rng.integers(len(a.numbers))
    return Atoms(a.numbers[keep], a.xyz[keep], a.box, a.pbc)


def _chosen_element(params: dict) -> int | None:
    name = params.get("element")
    if name is None:
        return None
    if name not in NUMBERS:
        raise invalid(f"unknown element {name!r}")
    return NUMBERS[name]


def add_atom(a: Atoms, rng: np.random.Generator, params: dict) -> Atoms | None:
    z = _chosen_element(params)
    if z is None:
        if not len(a.numbers):
            return None
        z = int(rng.choice(np.unique(a.numbers)))
    if a.pbc.any() and abs(np.linalg.det(a.box)) > 1e-8:
        spot = rng.uniform(size=3) @ a.box
    else:
        low, high = (a.xyz.min(axis=0) - 1.0, a.xyz.max(axis=0) + 1.0) if len(a.xyz) else (np.zeros(3), np.ones(3))
        spot = rng.uniform(low, high)
    return Atoms(np.append(a.numbers, z), np.vstack([a.xyz, spot]), a.box, a.pbc)


def substitute(a: Atoms, rng: np.random.Generator, params: dict) -> Atoms | None:
    z = _chosen_element(params)
    if z is not None:
        sites = np.flatnonzero(a.numbers != z)
        if not len(sites):
            return None
        site = int(rng.choice(sites))
    else:
        if len(np.unique(a.numbers)) < 2:
            return None
        site = int(rng.integers(len(a.numbers)))
        z = int(rng.choice(np.unique(a.numbers[a.numbers != a.numbers[site]])))
    numbers = a.numbers.copy()
    numbers[site] = z
    return Atoms(numbers, a.xyz, a.box, a.pbc)


def swap_unlike(a: Atoms, rng: np.random.Generator, params: dict) -> Atoms | None:
    if len(np.unique(a.numbers)) < 2:
        return None
    first = int(rng.integers(len(a.numbers)))
    second = int(rng.choice(np.flatnonzero(a.numbers != a.numbers[first])))
    numbers = a.numbers.copy()
    numbers[[first, second]] = numbers[[second, first]]
    return Atoms(numbers, a.xyz, a.box, a.pbc)


CHANGES: dict[str, Change] = {
    "atomic_displacement": displace, "isotropic_strain": strain_evenly, "anisotropic_strain": strain_by_axis, "cell_shear": shear,
    "vacancy": remove_atom, "interstitial_atom": add_atom, "substitution": substitute, "antisite_swap": swap_unlike,
}


# Genes that can stand in for a change's amplitude, and the parameter each one sets.
GENES = ("sigma", "strain", "shear")
AMPLITUDES = {
    "atomic_displacement": ("sigma", "max_sigma"), "isotropic_strain": ("strain", "max_strain"), "anisotropic_strain": ("strain", "max_strain"),
    "cell_shear": ("shear", "max_shear"),
}


@dataclass(frozen=True)
class Rules:
    """Geometry rules; the first one broken is the reason given."""

    min_distance_mode: str = "covalent"
    min_distance: float = 0.5
    min_distance_factor: float = 0.7
    pair_distances: tuple[tuple[str, str, float], ...] = ()
    max_displacement: float | None = None
    max_volume_change: float | None = 0.2
    min_volume_per_atom: float | None = None
    max_volume_per_atom: float | None = None
    composition_locked: bool = True
    atom_count_locked: bool = True

    def reason(self, a: Atoms, parent: Atoms) -> str | None:
        """The first entry of ``CHECKS`` that the structure fails, in words."""
        return next((words for words, broken in CHECKS.items() if broken(self, a, parent)), None)

    def _too_close(self, a: Atoms) -> bool:
        radii = np.asarray(RADII)[np.clip(a.numbers, 1, len(RADII)) - 1]
        if self.min_distance_mode == "covalent":
            limit = self.min_distance_factor * (radii[:, None] + radii[None, :])
        else:
            limit = np.full((len(radii), len(radii)), self.min_distance if self.min_distance_mode == "absolute" else 0.0)
        for x, y, d in self.pair_distances:
            hit = (a.numbers[:, None] == NUMBERS[x]) & (a.numbers[None, :] == NUMBERS[y])
            limit[hit | hit.T] = d
        points, repeats = prepared(a.xyz, a.box, a.pbc)
        reach = float(limit.max())
        if points is None or reach <= 0:
            return False
        shifts = stencil(a.box, a.pbc, reach, 2) if repeats else np.zeros((1, 3), dtype=np.int64)
        n = len(points)
        ghosts = (points[None, :, :] + (shifts @ a.box)[:, None, :]).reshape(-1, 3)
        i, g, d = close_pairs(points, ghosts, reach)
        own = (i == g % n) & (shifts[g // n] == 0).all(axis=1)
        return bool(((d < limit[i, g % n]) & ~own).any())


def _room(a: Atoms) -> float:
    """Volume per atom of a fully periodic structure; not a number for others, so that no bound holds."""
    return abs(np.linalg.det(a.box)) / len(a.numbers) if a.pbc.all() else float("nan")


def _over(value: float, bound: float | None) -> bool:
    return bound is not None and value > bound


# Cheap checks of the numbers come before the contact search, checks against the parent last.
CHECKS: dict[str, Callable[[Rules, Atoms, Atoms], bool]] = {
    "empty structure": lambda r, a, p: len(a.numbers) == 0,
    "a coordinate is not a number": lambda r, a, p: not (np.isfinite(a.xyz).all() and np.isfinite(a.box).all()),
    "the cell has no volume": lambda r, a, p: bool(a.pbc.any()) and abs(np.linalg.det(a.box)) < 1e-10,
    "too large a displacement": lambda r, a, p: _over(a.note.get("displacement", 0.0), r.max_displacement),
    "too large a volume change": lambda r, a, p: _over(abs(a.note.get("volume_change", 0.0)), r.max_volume_change),
    "too little volume per atom": lambda r, a, p: r.min_volume_per_atom is not None and _room(a) < r.min_volume_per_atom,
    "too much volume per atom": lambda r, a, p: _over(_room(a), r.max_volume_per_atom),
    "a contact is too short": lambda r, a, p: (r.min_distance_mode != "none" or bool(r.pair_distances)) and r._too_close(a),
    "another number of atoms": lambda r, a, p: r.atom_count_locked and len(a.numbers) != len(p.numbers),
    "another composition": lambda r, a, p: r.composition_locked and sorted(a.numbers.tolist()) != sorted(p.numbers.tolist()),
}


PROPOSED = (
    "i bigint, parent bigint, operator string, numbers array<int>, positions array<array<double>>, cell array<array<double>>, "
    "pbc array<boolean>, reason string"
)


def propose(plan: DataFrame, parents: DataFrame, params: dict[str, dict], rules: Rules, seed: int) -> DataFrame:
    """Candidates of a plan ``i, parent, operator``.

    The plan is small and meets the structures by an equi-join on the parent's id.
    It may carry ``genes`` in place of the given amplitudes, and ``tries``: the
    changes in the order in which one that does not apply gives way to the next.
    """
    bred = [name for name in ("genes", "tries") if name in plan.columns]

    def packed(name: str, as_id: str):
        return parents.select(F.col("i").alias(as_id), F.struct(
            "numbers", F.flatten("positions").alias("xyz"), F.flatten("cell").alias("box"), "pbc").alias(name))

    joined = plan.join(packed("base", "parent"), "parent")
    columns = ["i", "parent", "operator", "base", *bred]

    def settings(name: str, row: dict) -> dict:
        given = params.get(name, {})
        if row.get("genes") is None or name not in AMPLITUDES:
            return given
        gene, parameter = AMPLITUDES[name]
        return {**given, parameter: row["genes"][GENES.index(gene)]}

    def atoms(raw: dict) -> Atoms:
        return Atoms(np.asarray(raw["numbers"]), np.asarray(raw["xyz"], dtype=float).reshape(-1, 3),
                     np.asarray(raw["box"], dtype=float).reshape(3, 3), np.asarray(raw["pbc"], dtype=bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rng = np.random.default_rng([seed, row["i"]])
                base = atoms(row["base"])
                name, made = row["operator"], None
                # One that does not apply gives way to the others, in an order that is given or drawn for the row.
                tries = row.get("tries") or [name, *rng.permutation([n for n in CHANGES if n != name and (not params or n in params)]).tolist()]
                for name in tries:
                    made = CHANGES[name](base, rng, settings(name, row))
                    if made is not None:
                        break
                if made is None:
                    name = "atomic_displacement"
                    made = displace(base, rng, settings(name, row))
                out.append({
                    "i": row["i"], "parent": row["parent"], "operator": name, "numbers": made.numbers.astype(int).tolist(),
                    "positions": made.xyz.tolist(), "cell": made.box.tolist(), "pbc": made.pbc.tolist(), "reason": rules.reason(made, base)})
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return joined.select(*columns).mapInArrow(run, PROPOSED)


_SCHEMA = pa.schema([
    ("i", pa.int64()), ("parent", pa.int64()), ("operator", pa.string()), ("numbers", pa.list_(pa.int32())),
    ("positions", pa.list_(pa.list_(pa.float64()))), ("cell", pa.list_(pa.list_(pa.float64()))), ("pbc", pa.list_(pa.bool_())), ("reason", pa.string()),
])

