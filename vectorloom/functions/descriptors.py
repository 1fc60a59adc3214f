"""The hook for structure descriptors, with small public examples.

A descriptor is a plain function of one frame's arrays returning one vector per
atom or one for the whole frame.  It runs inside tasks over frame rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.contacts import each_frame, frame_contacts, packed

Descriptor = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def composition_vector(elements: tuple[int, ...]) -> Descriptor:
    """Element fractions of the frame."""
    return lambda numbers, _xyz, _box, _pbc: np.array([[np.mean(numbers == z) for z in elements]])


def radial_histogram(cutoff: float = 5.0, bins: int = 16, width: float | None = None) -> Descriptor:
    """Per atom: Gaussian-smeared neighbour distances, fading out at the cutoff."""
    centres = np.linspace(0.5, cutoff, bins)
    sigma = width or (centres[1] - centres[0])

    def run(numbers, xyz, box, pbc):
        a, _b, _image, d = frame_contacts(xyz, box, pbc, cutoff)
        weight = 0.5 * (np.cos(np.pi * d / cutoff) + 1.0)
        rows = np.exp(-0.5 * ((d[:, None] - centres[None, :]) / sigma) ** 2) * weight[:, None]
        out = np.zeros((len(numbers), bins))
        np.add.at(out, a, rows)
        return out

    return run


def smooth_coordination(cutoff: float = 4.0) -> Descriptor:
    """Per atom: the number of neighbours, each fading out towards the cutoff."""

    def run(numbers, xyz, box, pbc):
        a, _b, _image, d = frame_contacts(xyz, box, pbc, cutoff)
        return np.bincount(a, (1.0 - (d / cutoff) ** 2) ** 2, len(numbers))[:, None]

    return run


def coulomb_spectrum(size: int = 32) -> Descriptor:
    """Sorted eigenvalues of the charge matrix, padded to ``size``."""

    def run(numbers, xyz, _box, _pbc):
        gap = np.linalg.norm(xyz[:, None, :] - xyz[None, :, :], axis=2)
        np.fill_diagonal(gap, 1.0)
        table = np.outer(numbers, numbers) / np.maximum(gap, 1e-9)
        np.fill_diagonal(table, 0.5 * np.asarray(numbers, dtype=float) ** 2.4)
        values = np.sort(np.abs(np.linalg.eigvalsh(table)))[::-1][:size]
        return np.pad(values, (0, size - len(values)))[None, :]

    return run


def compute(frames: DataFrame, descriptor: Descriptor) -> DataFrame:
    """``frame, row, features`` for every vector the descriptor returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list]] = []
        for index, numbers, xyz, box, pbc in each_frame(batches):
            values = np.atleast_2d(descriptor(numbers, xyz, box, pbc))
            held.extend((index, row, v) for row, v in enumerate(values.tolist()))
            if len(held) >= 4096:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return packed(frames).mapInArrow(run, "frame bigint, row int, features array<double>")


def _batch(held: list[tuple[int, int, list]]) -> pa.RecordBatch:
    frame, row, values = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(frame, pa.int64()), pa.array(row, pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["frame", "row", "features"])


def frame_vector(descriptor: Descriptor, numbers, xyz, box, pbc) -> np.ndarray:
    """One vector per frame: the mean over its atoms."""
    values = np.atleast_2d(descriptor(numbers, xyz, box, pbc))
    return values.mean(axis=0) if len(values) else np.zeros(values.shape[1])
