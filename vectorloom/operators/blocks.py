"""Named blocks of what is known of a frame, for composite sampling spaces.

A block is a vector per frame, built by column expressions from the frame's own
row or from its descriptor vector; nothing is shuffled but the join of the two.
What a block needs must be there: a frame without it is an error, as a space
with a block left out would be another space than the one asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions import elements as el
from ..functions import geometry
from ..functions.vec import all_finite, norm, row_mean, row_std
from .sampling import composite

# The blocks' names; the last two are made from descriptor vectors.
FRAME_BLOCKS = ("lattice", "composition", "energy", "force")
VECTOR_BLOCKS = ("descriptor", "descriptor_summary")
BLOCKS = (*VECTOR_BLOCKS, *FRAME_BLOCKS)


def listed_elements(frames: DataFrame) -> list[int]:
    """The frames' atomic numbers in the order of their symbols."""
    found = frames.select(F.explode("numbers").alias("z")).distinct()
    return [r["z"] for r in found.select("z", el.symbol(F.col("z")).alias("s")).orderBy("s").collect()]


def lattice() -> Column:
    """Edges and angles of a cell that is not all zero."""
    shape = geometry.cell_parameters(F.col("cell"))
    solid = F.aggregate(F.flatten("cell"), F.lit(0.0), lambda a, x: a + F.abs(x)) > 1e-12
    return F.when(solid, F.array(*[shape[k] for k in ("a", "b", "c", "alpha", "beta", "gamma")]))


def energy() -> Column:
    return F.array(F.col("energy") / F.greatest(F.size("numbers"), F.lit(1)))


def force() -> Column:
    """Mean, largest and spread of the force magnitudes."""
    size = geometry.magnitudes(F.col("forces"))
    return F.when(F.size("forces") > 0, F.array(row_mean(size), F.array_max(size), row_std(size)))


def composition(elements: Sequence[int]) -> Column:
    """Share of each listed element; others count in the whole."""
    if not elements:
        raise invalid("the composition block requires a known element list")
    return el.fractions(F.col("numbers"), list(elements))


def descriptor_summary() -> Column:
    """Mean, spread and length of a descriptor vector."""
    x = F.col("features")
    return F.array(row_mean(x), row_std(x), norm(x))


def block_vectors(
    names: Sequence[str], frames: DataFrame | None = None, vectors: DataFrame | None = None, elements: Sequence[int] | None = None
) -> dict[str, DataFrame]:
    """``i, features`` for each named block, in the order given.

    ``frames`` are frame rows keyed ``frame_index``; ``vectors`` have ``i,
    features``, one row per frame.  Blocks of atoms are not made: a frame's
    cell, elements and energy are not an atom's.  Without ``elements`` those of
    the frames are taken.
    """
    unknown = [n for n in names if n not in BLOCKS]
    if unknown or not names or len(set(names)) != len(names):
        raise invalid("blocks must be distinct known names", known=list(BLOCKS), unknown=unknown)
    if frames is None and any(n in FRAME_BLOCKS for n in names):
        raise invalid("frame blocks require frames")
    if vectors is None and any(n in VECTOR_BLOCKS for n in names):
        raise invalid("descriptor blocks require descriptor vectors")
    found: dict[str, DataFrame] = {}
    for name in names:
        if name in VECTOR_BLOCKS:
            found[name] = vectors.select("i", F.col("features") if name == "descriptor" else descriptor_summary().alias("features"))
        else:
            made = composition(listed_elements(frames) if elements is None else elements) if name == "composition" else {"lattice": lattice, "energy": energy, "force": force}[name]()
            found[name] = frames.select(F.col("frame_index").alias("i"), made.alias("features"))
    _refuse_missing(found)
    return found


def _refuse_missing(blocks: dict[str, DataFrame]) -> None:
    """Every block has a finite vector for each row, and the same rows; a block is one pass of counts."""
    rows: dict[str, int] = {}
    for name, block in blocks.items():
        good = F.col("features").isNotNull() & all_finite(F.col("features"))
        n, missing = block.agg(F.count(F.lit(1)), F.count_if(~good)).first()
        if missing:
            raise invalid(f"rows without what the {name} block needs", block=name, missing=missing)
        rows[name] = n
    if len(set(rows.values())) > 1:
        raise invalid("blocks are not of the same rows", rows=rows)


def blocks_space(
    names: Sequence[str], frames: DataFrame | None = None, vectors: DataFrame | None = None, weights: dict[str, float] | None = None,
    scaling: str = "robust", elements: Sequence[int] | None = None, fitted_on: tuple[DataFrame | None, DataFrame | None] | None = None,
) -> DataFrame:
    """The blocks side by side, each scaled on its own and weighted by w/sqrt(width).

    ``fitted_on`` gives the frames and vectors of a set that scaling and the
    element list are taken from, as when samples are added to it.
    """
    if fitted_on is not None and elements is None and "composition" in names:
        elements = listed_elements(fitted_on[0])
    if elements is None and "composition" in names and frames is not None:
        elements = listed_elements(frames)
    made = block_vectors(names, frames, vectors, elements)
    base = None if fitted_on is None else block_vectors(names, *fitted_on, elements)
    return composite(made, weights, scaling, base)
