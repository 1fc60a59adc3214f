"""Small helpers between Arrow batches and numpy, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .errors import LoomError, invalid
from .session import broadcast_bytes


def matrix(column) -> np.ndarray:
    """A list<double> column as a dense float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def vectors(rows: np.ndarray, dtype=None) -> pa.Array:
    """A 2-D array as a list column."""
    rows = np.ascontiguousarray(rows)
    n, d = rows.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1), type=dtype))


def ragged(lists: Iterable[np.ndarray], dtype) -> pa.Array:
    lists = list(lists)
    sizes = np.fromiter((len(v) for v in lists), dtype=np.int32, count=len(lists))
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate(lists) if len(lists) and offsets[-1] else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=dtype))


def ints(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False))


def table_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Re-chunk a partition's batches to at most ``rows`` rows each."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def feature_width(df: DataFrame, column: str = "features") -> int:
    head = df.select(column).limit(1).collect()
    if not head:
        raise invalid("analysis input cannot be empty")
    width = len(head[0][0] or [])
    if width == 0:
        raise invalid("analysis input cannot be empty")
    return width


def small_matrix(df: DataFrame, what: str, limit_rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a set whose size is proven small, ordered by id.

    ``limit_rows`` states the operator's own bound; the byte bound for anything
    shipped to executors is checked either way, and exceeding it is an error,
    never a silent cut.
    """
    spark = df.sparkSession
    bound = broadcast_bytes(spark)
    probe = df.select("i", "features")
    if limit_rows is not None:
        rows = probe.limit(limit_rows + 1).toArrow()
        if rows.num_rows > limit_rows:
            raise invalid(f"{what} is limited to {limit_rows} rows")
    else:
        rows = probe.toArrow()
    if rows.nbytes > bound:
        raise LoomError("ANALYSIS_INPUT_INVALID", f"{what} exceeds the broadcast bound", bytes=rows.nbytes, bound=bound)
    ids = ints(rows.column("i").combine_chunks()).astype(np.int64)
    values = matrix(rows.column("features"))
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def held_rows(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a whole set on the driver, ordered by id."""
    rows = df.select("i", "features").toArrow()
    ids = ints(rows.column("i").combine_chunks()).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(rows.column("features"))[order]


def shipped_slices(spark, rows: np.ndarray) -> list[Broadcast]:
    """The rows in order, in broadcasts that are each within the bound."""
    step = max(1, broadcast_bytes(spark) // max(1, 8 * rows.shape[1]))
    return [spark.sparkContext.broadcast(rows[at : at + step]) for at in range(0, max(1, len(rows)), step)]
