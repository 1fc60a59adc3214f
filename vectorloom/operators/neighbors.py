"""Exact nearest neighbours and radius reductions between two vector sets.

Three physical forms give the same result:

* the reference fits a checked broadcast bound: every query partition scans it
  with a blocked numpy kernel; where pairs are many, query rows are dealt first;
* it is a few times that bound: it is scanned slice by slice, in leaves where coordinates are few;
* else: the reference is laid out once in the cells of a two-level tree of
  pivot vectors.  A query row first meets its own cell, which gives it a running
  k-th distance, then other cells in the order of the least distance that the
  triangle inequality leaves possible, a few at a time, until the next cell's
  exceeds the running one.  So a row travels to the cells around it, however
  many there are in all.  Cells are split into chunks on both sides so no task
  receives an unbounded group, and copies of one vector are one row throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import ints, matrix, ragged, small_matrix, table_batches, vectors
from ..errors import LoomError, invalid
from ..session import broadcast_bytes, cut_lineage

METRICS = ("euclidean", "cosine", "manhattan")
# What a search can measure by; the last is for the library's own use.
NORMS = (*METRICS, "chebyshev")
CHUNK_ROWS = 2048
# Rows of either side of a cell that meet in one task; a side goes once to each part of the other.
MEET_ROWS = 8 * CHUNK_ROWS
# Cells beside its own that a query row meets at a time, by their place in its order.
CELL_WAVES = ((0, 8), (8, 64), (64, None))
_TEMP_VALUES = 4 << 20
# Scores of a search exist for so many query and reference rows at a time.
TILE_ROWS, TILE_COLUMNS = 512, 2048
# Pairs that a task of a scan compares, and slices of a reference that are scanned rather than laid out in cells.
TASK_PAIRS, MOST_SLICES = 1 << 29, 16
# Rows of a leaf, and the most coordinates, of the scan that leaves rule out.
LEAF_ROWS, LEAF_WIDTH = 128, 8
# Coordinate differences of a tile of two blocks, few enough to stay in a core's cache.
_TILE_VALUES = 1 << 16
# Steps that a sum over all coordinates holds in 16 bits, and query rows of a tile that stays in a core's cache.
_MOST_SUM, _MANHATTAN_ROWS = 32_000, 32

NEIGHBOR_SCHEMA = "i bigint, indices array<bigint>, distances array<double>"


# --- numpy kernels -----------------------------------------------------------


def pair_distances(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """All distances between two blocks, by coordinate differences."""
    out = np.empty((len(q), len(r)))
    if metric == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)[None, :]
        return np.maximum(1.0 - (q @ r.T) / np.maximum(norms, 1e-15), 0.0)
    width = max(1, _TILE_VALUES // max(1, 4 * r.shape[1]))
    for start in range(0, len(r), width):
        tile = r[start : start + width]
        step = max(1, _TILE_VALUES // max(1, tile.size))
        for at in range(0, len(q), step):
            gap = q[at : at + step, None, :] - tile[None, :, :]
            if metric == "euclidean":
                part = np.sqrt(np.einsum("abc,abc->ab", gap, gap))
            else:
                np.abs(gap, out=gap)
                part = gap.max(axis=2) if metric == "chebyshev" else gap.sum(axis=2)
            out[at : at + step, start : start + width] = part
    return out


def _squared_screen(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by matrix product, with a bound on their rounding error."""
    shift = r.mean(axis=0)
    q, r = q - shift, r - shift
    qn, rn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
    approx = qn[:, None] + rn[None, :] - 2.0 * (q @ r.T)
    slack = 8.0 * (q.shape[1] + 4) * np.finfo(float).eps * (qn + (rn.max() if len(rn) else 0.0))
    return approx, slack


def screened_tiles(q: np.ndarray, r: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """Squared distances by matrix product, tile by tile, with a bound on their rounding error.

    ``start, columns, squares, slack``: the tile's first query row, its reference
    rows, and values that may be written to until the next tile, which takes their
    place.  Reference rows ascend for a query row.
    """
    shift = r.mean(axis=0)
    room = np.empty(0)
    for start in range(0, len(q), TILE_ROWS):
        a = q[start : start + TILE_ROWS] - shift
        qn = np.einsum("ij,ij->i", a, a)
        # Squared lengths ride along as two more coordinates, so one product gives the squared distances.
        a = np.column_stack([-2.0 * a, qn, np.ones(len(a))])
        for at in range(0, len(r), TILE_COLUMNS):
            b = r[at : at + TILE_COLUMNS] - shift
            rn = np.einsum("ij,ij->i", b, b)
            if room.size != len(a) * len(b):
                room = np.empty(len(a) * len(b))
            square = np.matmul(a, np.column_stack([b, np.ones(len(b)), rn]).T, out=room.reshape(len(a), len(b)))
            slack = 8.0 * (q.shape[1] + 4) * np.finfo(float).eps * (qn + rn.max())
            yield start, slice(at, at + len(b)), square, slack


def places_of(wanted: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows, places``: where each of the wanted ids stands in ``ids``, as often as it does; places ascend."""
    order = np.argsort(ids, kind="stable")
    listed = ids[order]
    first, last = np.searchsorted(listed, wanted, "left"), np.searchsorted(listed, wanted, "right")
    count = last - first
    rows = np.repeat(np.arange(len(wanted)), count)
    places = order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(rows))]
    by_place = np.argsort(places, kind="stable")
    return rows[by_place], places[by_place]


def held_places(rows: np.ndarray, places: np.ndarray, start: int, height: int, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """Those of the listed places that lie in a tile, counted from its corner."""
    part = slice(*np.searchsorted(places, [columns.start, columns.stop]))
    inside = (rows[part] >= start) & (rows[part] < start + height)
    return rows[part][inside] - start, places[part][inside] - columns.start


def listed(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a tile's hits, in the order of the rows."""
    return np.divmod(np.flatnonzero(hits.reshape(-1)), hits.shape[1])


def _gaps(q: np.ndarray, rows: np.ndarray, r: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of listed pairs, by coordinate differences."""
    out = np.empty(len(rows))
    step = max(1, _TEMP_VALUES // (4 * max(1, q.shape[1])))
    for at in range(0, len(rows), step):
        gap = q[rows[at : at + step]] - r[cols[at : at + step]]
        out[at : at + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _sums_of_gaps(q: np.ndarray, rows: np.ndarray, r: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Manhattan distances of listed pairs, by coordinate differences."""
    out = np.empty(len(rows))
    step = max(1, _TEMP_VALUES // (4 * max(1, q.shape[1])))
    for at in range(0, len(rows), step):
        gap = q[rows[at : at + step]] - r[cols[at : at + step]]
        out[at : at + step] = np.abs(gap, out=gap).sum(axis=1)
    return out


def _manhattan_tiles(q: np.ndarray, r: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """Manhattan distances of coordinates rounded to 16-bit steps, tile by tile, with a bound on their error.

    Sums of small whole numbers take a fraction of the time of exact differences.
    A coordinate is off by half a step at most, a pair by a step per coordinate.
    """
    low, high = np.minimum(q.min(axis=0), r.min(axis=0)), np.maximum(q.max(axis=0), r.max(axis=0))
    width = q.shape[1]
    step = max(float((high - low).max()) / (_MOST_SUM // width), np.finfo(float).tiny)
    whole_q, whole_r = (np.ascontiguousarray(np.rint((part - low) / step).astype(np.int16).T) for part in (q, r))
    # Room for the rounding of the division, the product and the exact sums.
    error = width * step + 8 * np.finfo(float).eps * width * float((high - low).sum() + np.abs(low).max() + np.abs(high).max())
    gap = np.empty((_MANHATTAN_ROWS, TILE_COLUMNS), dtype=np.int16)
    for start in range(0, len(q), TILE_ROWS):
        for at in range(0, len(r), TILE_COLUMNS):
            own, other = whole_q[:, start : start + TILE_ROWS], whole_r[:, at : at + TILE_COLUMNS]
            total = np.zeros((own.shape[1], other.shape[1]), dtype=np.int16)
            for first in range(0, len(total), _MANHATTAN_ROWS):
                part = total[first : first + _MANHATTAN_ROWS]
                room = gap[: part.shape[0], : part.shape[1]]
                for c in range(width):
                    np.subtract(own[c, first : first + _MANHATTAN_ROWS, None], other[c, None, :], out=room)
                    part += np.abs(room, out=room)
            yield start, slice(at, at + total.shape[1]), total * step, np.full(len(total), error)


def _moderate(rows: np.ndarray) -> bool:
    """Finite, and far from where differences overflow."""
    return bool(np.abs(rows).max(initial=0.0) < 1e150)


def _screened(q: np.ndarray, r: np.ndarray, metric: str) -> tuple[Iterator[tuple[int, slice, np.ndarray, np.ndarray]], Callable | None]:
    """Tiles of scores, and what gives the distances of listed pairs where the scores only screen."""
    if metric == "euclidean":
        return _scored_tiles(q, r, metric), _gaps
    if metric == "manhattan" and 8 <= q.shape[1] <= _MOST_SUM // 64 and _moderate(q) and _moderate(r):
        return _manhattan_tiles(q, r), _sums_of_gaps
    return _scored_tiles(q, r, metric), None


def _scored_tiles(q: np.ndarray, r: np.ndarray, metric: str) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    if metric == "euclidean":
        yield from screened_tiles(q, r)
        return
    for start in range(0, len(q), TILE_ROWS):
        part = q[start : start + TILE_ROWS]
        for at in range(0, len(r), TILE_COLUMNS):
            score = pair_distances(part, r[at : at + TILE_COLUMNS], metric)
            yield start, slice(at, at + score.shape[1]), score, np.zeros(len(part))


def nearest_block(
    q: np.ndarray, q_ids: np.ndarray, r: np.ndarray, r_ids: np.ndarray, k: int, metric: str, skip_self: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` reference rows per query row by (distance, id).

    Flat arrays ``row, id, distance`` sorted by row, distance, id.  A matrix
    product or rounded coordinates only screen; kept distances are differences, so equal rows are at
    exactly zero.  Scores exist for one tile at a time, and what a tile adds is
    compared with the k best before it.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(r) or not len(q):
        return none, none, np.zeros(0)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best = (none, none, np.zeros(0))
    edge = np.full(0, np.inf)
    own = places_of(q_ids, r_ids) if skip_self else (none, none)
    tiles, exactly = _screened(q, r, metric)
    for start, columns, score, slack in tiles:
        if columns.start == 0:
            done.append(best)
            best, edge = (none, none, np.zeros(0)), np.full(len(score), np.inf)
        score[held_places(*own, start, len(score), columns)] = np.inf
        limit = edge
        if columns.start == 0:
            width = min(k, score.shape[1])
            limit = np.partition(score, width - 1, axis=1)[:, width - 1]
            limit = np.where(np.isnan(limit) | (width < k), np.inf, limit)
        rows, cols = listed(score <= (limit + 2 * slack)[:, None])
        found = score[rows, cols]
        if not (kept := np.isfinite(found)).all():
            rows, cols, found = rows[kept], cols[kept], found[kept]
        if len(rows):
            exact = found if exactly is None else exactly(q, rows + start, r, cols + columns.start)
            fresh.append((rows + start, r_ids[cols + columns.start], exact))
        # What some tiles add is sorted in at once; until then the edge is only too wide.
        waiting = sum(len(part[0]) for part in fresh)
        if not waiting or (columns.start and columns.stop < len(r) and 2 * waiting < k * len(score)):
            continue
        best = _k_lowest(*(np.concatenate(part) for part in zip(best, *fresh)), k)
        fresh = []
        # The running k-th distance, once a row has k.
        ends = np.searchsorted(best[0], np.arange(start, start + len(score)), "right")
        full = np.diff(np.searchsorted(best[0], np.arange(start, start + len(score) + 1))) == k
        edge = np.where(full, best[2][ends - 1], np.inf)
        if metric == "euclidean":
            edge = edge * edge * (1 + 1e-12)
    done.append(best)
    return tuple(np.concatenate(part) for part in zip(*done))


def _k_lowest(rows: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, exact, rows))
    rows, ids, exact = rows[order], ids[order], exact[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], ids[kept], exact[kept]


def least_cost(
    q: np.ndarray, r: np.ndarray, score: Callable, cost: Callable, scale: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The first reference row of least cost per query row, and the cost; infinite and -1 where there is none.

    ``score(rows, columns, squares)`` gives squared costs of a tile, infinite for
    pairs left out, off by at most ``scale`` times as much as the squared distance
    is; ``cost(rows, cols, distances)`` gives the costs of listed pairs.
    """
    least, place = np.full(len(q), np.inf), np.full(len(q), -1, dtype=np.int64)
    for start, columns, square, slack in screened_tiles(q, r):
        mine = slice(start, start + len(square))
        found = score(mine, columns, square)
        limit = np.minimum(found.min(axis=1), least[mine] ** 2)
        rows, cols = listed(found <= (limit * (1 + 1e-12) + 2 * slack * scale[mine])[:, None])
        open_ = np.isfinite(found[rows, cols])
        rows, cols = rows[open_] + start, cols[open_] + columns.start
        if not len(rows):
            continue
        exact = cost(rows, cols, _gaps(q, rows, r, cols))
        order = np.lexsort((cols, exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.concatenate([[True], rows[1:] != rows[:-1]])
        rows, cols, exact = rows[first], cols[first], exact[first]
        lower = exact < least[rows]
        least[rows[lower]], place[rows[lower]] = exact[lower], cols[lower]
    return least, place


# --- broadcast form ----------------------------------------------------------


def _fits(df: DataFrame, width: int) -> bool:
    return df.count() * (width + 2) * 8 <= broadcast_bytes(df.sparkSession)


def scanned(reference: DataFrame) -> bool:
    """Whether a reference is compared as a whole, in one or some broadcasts, rather than laid out in cells."""
    width = _width(reference)
    slices = -(-reference.count() * (width + 2) * 8 * 5 // (4 * broadcast_bytes(reference.sparkSession)))
    return _fits(reference, width) or (width > LEAF_WIDTH and slices <= MOST_SLICES)


def _width(df: DataFrame) -> int:
    row = df.select(F.size("features").alias("d")).limit(1).collect()
    if not row:
        raise invalid("neighbour search needs at least one reference row")
    return row[0]["d"]


def _dealt(query: DataFrame, reference_rows: int) -> DataFrame:
    """Query rows in parts with a bounded number of pairs each, whatever files they come from."""
    if reference_rows < CHUNK_ROWS:
        return query
    context = query.sparkSession.sparkContext
    parts = -(-query.count() * reference_rows // TASK_PAIRS)
    return query if parts < 2 else query.repartition(max(parts, context.defaultParallelism))


def _scan_small(reference: DataFrame, query: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
    ids, rows = small_matrix(reference, "broadcast reference")
    query = _dealt(query.select("i", "features"), len(ids))
    return _scanned(query.sparkSession.sparkContext.broadcast((ids, rows)), query, k, metric, skip_self)


def _scan_slices(reference: DataFrame, query: DataFrame, k: int, metric: str, skip_self: bool, rows: int, slices: int) -> DataFrame:
    """The scan with one slice of the reference after another; a row keeps the best of all slices.

    Where many coordinates leave cells nothing to rule out, a row would travel to
    nearly every cell.  Here it stays, and one slice is held and shipped at a time.
    Where few do, a slice lies in leaves, and a row meets those that it reaches, which
    takes less room than rows copied to the cells around them.
    """
    spark = query.sparkSession
    # Ids may repeat, so rows are told apart by a number.
    scanned = cut_lineage(_dealt(query, -(-rows // slices)).select(F.monotonically_increasing_id().alias("tag"), "i", "features"))
    found = None
    for number in range(slices):
        packed = reference.where(F.pmod(F.xxhash64("i", "features"), F.lit(slices)) == number).toArrow()
        if not packed.num_rows:
            continue
        if packed.nbytes > 2 * broadcast_bytes(spark) + (1 << 20):
            raise LoomError("ANALYSIS_INPUT_INVALID", "reference slice exceeds the broadcast bound", bytes=packed.nbytes)
        part = ints(packed.column("i").combine_chunks()), matrix(packed.column("features"))
        if boxed(part[1].shape[1], metric) and np.isfinite(part[1]).all():
            lists, shared = _leaf_scanned(*part, scanned, k, metric, skip_self)
        else:
            shared = spark.sparkContext.broadcast(part)
            lists = _scanned(shared, scanned, k, metric, skip_self)
        lists = cut_lineage(lists)
        shared.destroy()
        found = lists if found is None else found.unionByName(lists)
    pairs = F.flatten(F.collect_list(F.arrays_zip(F.col("distances").alias("d"), F.col("indices").alias("j"))))
    best = found.groupBy("tag").agg(F.first("i").alias("i"), F.slice(F.array_sort(pairs), 1, k).alias("best"))
    return best.select("i", F.transform("best", lambda b: b["j"]).alias("indices"), F.transform("best", lambda b: b["d"]).alias("distances"))


def _scanned(shared: Broadcast, query: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
    """The k best of the broadcast ids and vectors for each query row; other columns of the query stay."""
    kept = [name for name in query.columns if name != "features"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = shared.value
        for batch in table_batches(batches, CHUNK_ROWS):
            q_ids, q = ints(batch.column("i")), matrix(batch.column("features"))
            at, found, dist = nearest_block(q, q_ids, rows, ids, k, metric, skip_self)
            cut = np.searchsorted(at, np.arange(1, len(q_ids)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), ragged(np.split(found, cut), pa.int64()), ragged(np.split(dist, cut), pa.float64())],
                names=[*kept, "indices", "distances"],
            )

    return query.mapInArrow(scan, "".join(f"{name} bigint, " for name in kept) + "indices array<bigint>, distances array<double>")


# --- broadcast form for few coordinates --------------------------------------


class _Leaves:
    """Rows in the leaves of a tree of median cuts, each leaf with the box around its rows."""

    def __init__(self, rows: np.ndarray):
        self.nodes: list[list] = []  # coordinate, cut, left, right; a leaf has -1 and its number
        order: list[np.ndarray] = []

        def add(places: np.ndarray) -> int:
            here = len(self.nodes)
            self.nodes.append([-1, 0.0, len(order), -1])
            part = rows[places]
            if len(places) <= LEAF_ROWS:
                order.append(places)
                return here
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
            middle = len(places) // 2
            split = np.argpartition(part[:, axis], middle)
            left, right = add(places[split[:middle]]), add(places[split[middle:]])
            self.nodes[here] = [axis, float(part[split[middle], axis]), left, right]
            return here

        add(np.arange(len(rows)))
        self.order = np.concatenate(order)
        self.starts = np.cumsum([0] + [len(part) for part in order])
        self.low = np.minimum.reduceat(rows[self.order], self.starts[:-1])
        self.high = np.maximum.reduceat(rows[self.order], self.starts[:-1])

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        axis, cut, left, right = (np.array(c) for c in zip(*self.nodes))
        node = np.zeros(len(points), dtype=np.int64)
        while len(moving := np.flatnonzero(axis[node] >= 0)):
            here = node[moving]
            node[moving] = np.where(points[moving, axis[here]] < cut[here], left[here], right[here])
        return left[node]

    def gaps(self, points: np.ndarray, metric: str) -> np.ndarray:
        """The least distance that each leaf's box leaves between its rows and each point."""
        out = np.empty((len(points), len(self.low)))
        step = max(1, _TEMP_VALUES // (8 * self.low.size))
        for at in range(0, len(points), step):
            part = points[at : at + step, None, :]
            apart = np.maximum(np.maximum(self.low - part, part - self.high), 0.0)
            if metric == "euclidean":
                out[at : at + step] = np.sqrt(np.einsum("abc,abc->ab", apart, apart))
            else:
                out[at : at + step] = apart.max(axis=2) if metric == "chebyshev" else apart.sum(axis=2)
        return out

    def places(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[k], self.starts[k + 1]) for k in np.sort(leaves)])


def boxed(width: int, metric: str) -> bool:
    """Boxes rule out little where there are many coordinates, and bound no cosine."""
    return metric != "cosine" and width <= LEAF_WIDTH


def _scan_leaves(reference: DataFrame, query: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
    """The scan where few coordinates let boxes of rows rule out most of the reference.

    Query rows are dealt by the leaf they fall in; those of a leaf meet the nearest
    leaves first, then all that their running k-th distances reach.
    """
    r_ids, r = small_matrix(reference, "broadcast reference")
    if not np.isfinite(r).all():
        return _scan_small(reference, query, k, metric, skip_self)
    return _leaf_scanned(r_ids, r, query.select("i", "features"), k, metric, skip_self)[0]


def _leaf_scanned(r_ids: np.ndarray, r: np.ndarray, query: DataFrame, k: int, metric: str, skip_self: bool) -> tuple[DataFrame, Broadcast]:
    """The k best of finite rows for each query row, and what was shipped for it; other columns of the query stay."""
    kept = [name for name in query.columns if name != "features"]
    tree = _Leaves(r)
    spark = query.sparkSession
    shared = spark.sparkContext.broadcast((tree, r_ids[tree.order], r[tree.order]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value[0].leaf_of(matrix(batch.column("features"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in [*kept, "features"]), pa.array(leaf, pa.int64())], names=[*kept, "features", "leaf"])

    def near(q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tree, ids, rows = shared.value
        gap = tree.gaps(q, metric)
        order = np.argsort(gap.min(axis=0), kind="stable")
        sizes = np.cumsum(np.diff(tree.starts)[order])
        some = tree.places(order[: np.searchsorted(sizes, 16 * LEAF_ROWS + k) + 1])
        at, _found, dist = nearest_block(q, q_ids, rows[some], ids[some], k, metric, skip_self)
        reach = np.full(len(q), np.inf)
        held = np.bincount(at, minlength=len(q))
        reach[held == k] = dist[np.cumsum(held)[held == k] - 1]
        reached = ~(gap > (reach * (1 + 1e-9) + 1e-12)[:, None])
        found = []
        # Rows of like reach together, so that a lone row does not widen what all must meet.
        for mine in np.array_split(np.argsort(reach, kind="stable"), -(-len(q) // 32)):
            mine = np.sort(mine)
            wanted = tree.places(np.flatnonzero(reached[mine].any(axis=0)))
            row, other, d = nearest_block(q[mine], q_ids[mine], rows[wanted], ids[wanted], k, metric, skip_self)
            found.append((mine[row], other, d))
        row, other, d = (np.concatenate(part) for part in zip(*found))
        order = np.argsort(row, kind="stable")
        return row[order], other[order], d[order]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = ints(batch.column("leaf"))
            edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
            for first, last in zip(edges[:-1], edges[1:]):
                for part in table_batches([batch.slice(first, last - first)], TILE_ROWS):
                    q_ids, q = ints(part.column("i")), matrix(part.column("features"))
                    at, found, dist = near(q_ids, q)
                    cut = np.searchsorted(at, np.arange(1, len(q_ids)))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(name) for name in kept), ragged(np.split(found, cut), pa.int64()), ragged(np.split(dist, cut), pa.float64())],
                        names=[*kept, "indices", "distances"])

    names = "".join(f"{name} bigint, " for name in kept)
    placed = query.mapInArrow(place, names + "features array<double>, leaf bigint")
    parts = max(4 * spark.sparkContext.defaultParallelism, len(r_ids) // (4 * CHUNK_ROWS))
    dealt = placed.repartitionByRange(parts, "leaf", "i").sortWithinPartitions("leaf")
    return dealt.mapInArrow(scan, names + "indices array<bigint>, distances array<double>"), shared


# --- block form --------------------------------------------------------------


def _metric_space(df: DataFrame, metric: str) -> DataFrame:
    """Vectors in a space where the triangle inequality holds.

    Cosine becomes euclidean on unit vectors; a zero vector, whose cosine
    distance to everything is one, gets its own axis.
    """
    if metric != "cosine":
        return df.withColumn("point", F.col("features"))
    size = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
    zero = size <= 1e-15
    unit = F.transform("features", lambda x: F.when(zero, F.lit(0.0)).otherwise(x / size))
    return df.withColumn("point", F.concat(unit, F.array(F.when(zero, F.lit(1.0)).otherwise(F.lit(0.0)))))


def _collapse(df: DataFrame, copies: int) -> DataFrame:
    """One row per distinct vector, with its lowest ids and its multiplicity."""
    counted = df.groupBy("features").agg(F.count(F.lit(1)).alias("copies"))
    ranked = df.select("i", "features", F.row_number().over(Window.partitionBy("features").orderBy("i")).alias("_n"))
    lowest = ranked.where(F.col("_n") <= copies).groupBy("features").agg(F.array_sort(F.collect_list("i")).alias("ids"))
    return lowest.join(counted, "features").select(F.col("ids")[0].alias("i"), "features", "ids", "copies")


class BlockTree:
    """The reference in the cells of a two-level pivot tree, and what query rows must meet of it.

    Pivots are reference rows drawn by a hash, as many as the broadcast bound
    allows; the square root of their number are the upper level.
    """

    def __init__(self, reference: DataFrame, query: DataFrame, metric: str, cell_rows: int | None = None):
        self.norm = "euclidean" if metric == "cosine" else metric
        width = _width(reference.select(F.col("point").alias("features")))
        # Beside its vector a pivot has its parent and its cell's facts.
        most = max(1, broadcast_bytes(reference.sparkSession) // (8 * (width + 6)))
        rows = reference.count()
        # As many cells as rows in each, where that leaves cells of a size worth a task.
        wanted = int(np.clip(np.ceil(rows / (cell_rows or np.clip(np.sqrt(rows), 64, 4 * CHUNK_ROWS))), 1, most))
        picked = matrix(reference.orderBy(F.xxhash64("i")).limit(wanted).select("point").toArrow().column("point"))
        uppers = picked[: int(np.ceil(np.sqrt(len(picked))))]
        used, parent = np.unique(pair_distances(picked, uppers, self.norm).argmin(axis=1), return_inverse=True)
        order = np.argsort(parent, kind="stable")
        self.uppers, self.pivots = uppers[used], picked[order]
        self.first = np.searchsorted(parent[order], np.arange(len(used) + 1))
        self.reference = cut_lineage(self._assigned(_tagged(reference)))
        self.query = cut_lineage(self._assigned(_tagged(query)))
        self._measure()

    def _measure(self) -> None:
        """Counts and reaches of the cells: a row per pivot."""
        count = len(self.pivots)
        self.count, self.near, self.far = np.zeros(count, dtype=np.int64), np.full(count, np.inf), np.full(count, -1.0)
        told = self.reference.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("near"), F.max("reach").alias("far"))
        for row in told.collect():
            self.count[row["cell"]], self.near[row["cell"]], self.far[row["cell"]] = row["n"], row["near"], row["far"]
        self.upper_far = np.full(len(self.uppers), -np.inf)
        for k, (a, b) in enumerate(zip(self.first[:-1], self.first[1:])):
            filled = self.count[a:b] > 0
            if filled.any():
                self.upper_far[k] = (pair_distances(self.uppers[k : k + 1], self.pivots[a:b][filled], self.norm)[0] + self.far[a:b][filled]).max()

    def _assigned(self, df: DataFrame) -> DataFrame:
        """Adds the row's cell and the distance to its pivot."""
        shared = df.sparkSession.sparkContext.broadcast((self.uppers, self.pivots, self.first, self.norm))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uppers, pivots, first, norm = shared.value
            for batch in table_batches(batches, CHUNK_ROWS):
                points = matrix(batch.column("point"))
                cell, reach = np.zeros(len(points), dtype=np.int32), np.zeros(len(points))
                above = pair_distances(points, uppers, norm).argmin(axis=1)
                for k in np.unique(above):
                    rows = np.flatnonzero(above == k)
                    gaps = pair_distances(points[rows], pivots[first[k] : first[k + 1]], norm)
                    best = gaps.argmin(axis=1)
                    cell[rows], reach[rows] = first[k] + best, gaps[np.arange(len(rows)), best]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(reach)], names=[*batch.schema.names, "cell", "reach"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", cell int, reach double"
        return df.mapInArrow(place, schema)

    def reachable(self, limits: DataFrame, first: int, last: int | None) -> DataFrame:
        """``i, cell``: the filled cells beside the row's own that may hold something within ``limit``.

        ``limits`` has ``i, point, cell, limit``.  A row's cells are in the
        order of their least possible distance; those at places ``first`` to
        ``last`` are given.  A smaller limit only cuts the order's end.
        """
        shared = limits.sparkSession.sparkContext.broadcast((self.uppers, self.pivots, self.first, self.norm, self.count, self.near, self.far, self.upper_far))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uppers, pivots, starts, norm, count, near, far, upper_far = shared.value
            for batch in table_batches(batches, 512):
                ids, own, points = ints(batch.column("i")), ints(batch.column("cell")), matrix(batch.column("point"))
                # Room for the rounding of the distances.
                limit = ints(batch.column("limit")) * (1 + 1e-9) + 1e-12
                close = pair_distances(points, uppers, norm) - upper_far[None, :] <= limit[:, None]
                found = []
                for k in np.flatnonzero(close.any(axis=0)):
                    rows, cells = np.flatnonzero(close[:, k]), np.arange(starts[k], starts[k + 1])
                    gaps = pair_distances(points[rows], pivots[cells], norm)
                    low = np.maximum(np.maximum(gaps - far[cells], near[cells] - gaps), 0.0)
                    r, c = np.nonzero((low <= limit[rows, None]) & (count[cells] > 0) & (cells != own[rows, None]))
                    found.append((rows[r], low[r, c], cells[c]))
                if not found:
                    continue
                row, low, cell = (np.concatenate(part) for part in zip(*found))
                order = np.lexsort((cell, low, row))
                row, cell = row[order], cell[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = (place >= first) & (place < (len(pivots) if last is None else last))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[kept]], pa.int64()), pa.array(cell[kept].astype(np.int32))], names=["i", "cell"])

        return limits.select("i", "point", "cell", "limit").mapInArrow(route, "i bigint, cell int")

    def meet(self, asked: DataFrame, kernel: Callable, schema: str) -> DataFrame:
        """Runs ``kernel(q_ids, q, q_tag, r_ids, r, r_tag) -> arrays`` for the query rows and cells of ``i, cell``."""
        rows = self.query.select("i", "features", "tag")
        asked = asked.join(rows, "i")
        wanted = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
        facts = F.broadcast(asked.sparkSession.createDataFrame(
            [(r["cell"], -(-r["n"] // MEET_ROWS), max(1, -(-int(self.count[r["cell"]]) // MEET_ROWS))) for r in wanted],
            "cell int, q_parts int, r_parts int",
        ))

        def dealt(df: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
            mine = F.pmod(F.xxhash64("i"), F.col(own_parts)).cast("int").alias(own)
            return df.join(facts, "cell").select("i", "features", "tag", "cell", mine, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)).alias(other))

        q = dealt(asked, "q_part", "q_parts", "r_part", "r_parts")
        r = dealt(self.reference, "r_part", "r_parts", "q_part", "q_parts")
        names = [part.strip().split(" ")[0] for part in schema.split(", ")]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            columns = kernel(
                ints(left.column("i")), matrix(left.column("features")), ints(left.column("tag")),
                ints(right.column("i")), matrix(right.column("features")), ints(right.column("tag")),
            )
            return pa.Table.from_arrays([pa.array(c) for c in columns], names=names)

        keys = ["cell", "q_part", "r_part"]
        return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(run, schema)

    def reduce(self, kernel: Callable, schema: str, radius: float) -> DataFrame:
        """The kernel's rows over each query row's own cell and all others within ``radius``."""
        around = self.reachable(self.query.withColumn("limit", F.lit(float(radius))), 0, None)
        return self.meet(cut_lineage(self.query.select("i", "cell").unionByName(around)), kernel, schema)


def _tagged(df: DataFrame) -> DataFrame:
    return df if "tag" in df.columns else df.withColumn("tag", F.lit(0).cast("bigint"))


def _best_of(rows: DataFrame, need: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("d", "r")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= need).drop("_n")


def _scan_blocks(reference: DataFrame, query: DataFrame, k: int, metric: str, skip_self: bool, cell_rows: int | None = None) -> DataFrame:
    # With copies collapsed, a vector's own ids stand beside it: keep one more.
    need = k + 1 if skip_self else k
    ref = _metric_space(_collapse(reference, need), metric)
    qry = _metric_space(_collapse(query, 1), metric)
    tree = BlockTree(ref, qry.drop("ids", "copies"), metric, cell_rows)

    def best(q_ids, q, _qt, r_ids, r, _rt):
        if not len(q_ids) or not len(r_ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, found, dist = nearest_block(q, q_ids, r, r_ids, need, metric, False)
        return q_ids[at], found, dist

    schema = "q bigint, r bigint, d double"
    top = cut_lineage(_best_of(tree.meet(tree.query.select("i", "cell"), best, schema), need))
    for first, last in CELL_WAVES:
        # A cosine distance is half the squared distance of unit vectors.
        reach = F.sqrt(2 * F.greatest(F.max("d"), F.lit(0.0)) + 1e-12) if metric == "cosine" else F.max("d")
        running = top.groupBy("q").agg(F.when(F.count(F.lit(1)) >= need, reach).alias("limit"))
        limits = tree.query.join(running.withColumnRenamed("q", "i"), "i", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        asked = cut_lineage(tree.reachable(limits, first, last))
        if not asked.isEmpty():
            top = cut_lineage(_best_of(top.unionByName(tree.meet(asked, best, schema)), need))
    # Back from vectors to rows: every copy of the query, the lowest ids of each neighbour.
    owners = query.groupBy("features").agg(F.min("i").alias("q"))
    members = query.select("i", "features").join(owners, "features").select("i", "q")
    spread = top.join(ref.select(F.col("i").alias("r"), "ids"), "r").select("q", "d", F.explode("ids").alias("j"))
    short = Window.partitionBy("q").orderBy("d", "j")
    lists = (
        spread.withColumn("_n", F.row_number().over(short)).where(F.col("_n") <= need)
        .groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("best"))
    )
    rows = members.join(lists, "q")
    mine = F.filter("best", lambda b: b["j"] != F.col("i")) if skip_self else F.col("best")
    cut = F.slice(mine, 1, k)
    return rows.select("i", F.transform(cut, lambda b: b["j"]).alias("indices"), F.transform(cut, lambda b: b["d"]).alias("distances"))


# --- public ------------------------------------------------------------------


def nearest(
    reference: DataFrame,
    query: DataFrame,
    k: int = 1,
    metric: str = "euclidean",
    skip_self: bool = False,
    cell_rows: int | None = None,
) -> DataFrame:
    """Exact k nearest reference rows of every query row.

    One row per query row, neighbours ordered by (distance, id).  With
    ``skip_self`` a row is never its own neighbour, but its copies are.
    """
    if metric not in NORMS:
        raise invalid("metric must be euclidean, cosine, or manhattan")
    if k < 1:
        raise invalid("k must be >= 1")
    reference, query = reference.select("i", "features"), query.select("i", "features")
    width = _width(reference)
    rows = reference.count()
    wide, bound = rows * (width + 2) * 8, broadcast_bytes(reference.sparkSession)
    if wide <= bound:
        return (_scan_leaves if boxed(width, metric) else _scan_small)(reference, query, k, metric, skip_self)
    slices = -(-wide * 5 // (4 * bound))
    if (width > LEAF_WIDTH or boxed(width, metric)) and slices <= MOST_SLICES and cell_rows is None:
        return _scan_slices(reference, query, k, metric, skip_self, rows, slices)
    return _scan_blocks(reference, query, k, metric, skip_self, cell_rows)


def self_nearest(df: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    return nearest(df, df, k, metric, skip_self=True)


def exploded(found: DataFrame) -> DataFrame:
    """Long form: ``i, rank, j, distance`` with rank from 1."""
    return found.select(
        "i", F.posexplode(F.arrays_zip(F.col("indices").alias("j"), F.col("distances").alias("d"))).alias("p", "b")
    ).select("i", (F.col("p") + 1).alias("rank"), F.col("b.j").alias("j"), F.col("b.d").alias("distance"))


def similar_to(df: DataFrame, query_index: int, k: int, metric: str = "cosine") -> DataFrame:
    """Neighbours of one row: its vector is one literal, the rest is a top-k scan."""
    from ..functions.vec import distance, literal, similarity

    if metric not in ("euclidean", "cosine"):
        raise invalid("similarity metric must be euclidean or cosine")
    row = df.where(F.col("i") == query_index).select("features").limit(1).collect()
    if not row:
        raise invalid("query_index is out of range")
    d = distance(metric, F.col("features"), literal(row[0]["features"]))
    return (
        df.where(F.col("i") != query_index)
        .select(F.col("i").alias("j"), d.alias("distance"))
        .orderBy("distance", "j")
        .limit(k)
        .withColumn("similarity", similarity(metric, F.col("distance")))
    )


def within_radius(reference: DataFrame, query: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """How many reference rows lie within ``radius`` of each query row, itself included."""
    counts = _radius_reduce(reference.select("i", "features", F.lit(0).cast("bigint").alias("tag")), query, radius, metric)
    return counts.groupBy("i").agg(F.sum("hits").cast("bigint").alias("hits"))


def radius_tiles(q, r, radius, metric) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """``rows, columns, hits`` tile by tile, screened by matrix product and settled by differences."""
    limit = radius * radius
    for start, columns, score, slack in _scored_tiles(q, r, metric):
        if metric == "euclidean":
            hits = score <= (limit - 2 * slack - 1e-12 * limit)[:, None]
            rows, cols = np.nonzero((score <= (limit + 2 * slack + 1e-12 * limit)[:, None]) & ~hits)
            if len(rows):
                hits[rows, cols] = _gaps(q, rows + start, r, cols + columns.start) <= radius
        else:
            hits = score <= radius
        yield slice(start, start + len(score)), columns, hits


def radius_counts(q, r, weight, radius, metric) -> np.ndarray:
    """Sum of the weights within ``radius`` of each query row."""
    found = np.zeros(len(q), dtype=np.int64)
    for rows, columns, hits in radius_tiles(q, r, radius, metric):
        found[rows] += (hits @ weight[columns]).astype(np.int64)
    return found


def radius_lowest(q, r, tag, radius, metric) -> np.ndarray:
    """The lowest tag within ``radius`` of each query row, or the largest number."""
    top = np.iinfo(np.int64).max
    found = np.full(len(q), top)
    for rows, columns, hits in radius_tiles(q, r, radius, metric):
        found[rows] = np.minimum(found[rows], np.where(hits, tag[None, columns], top).min(axis=1))
    return found


def _radius_reduce(reference: DataFrame, query: DataFrame, radius: float, metric: str) -> DataFrame:
    """Partial rows ``i, hits, low``: neighbour count and lowest tag per chunk."""
    schema = "i bigint, hits bigint, low bigint"
    top = np.iinfo(np.int64).max

    def kernel(q_ids, q, _qt, r_ids, r, r_tag):
        if not len(q_ids) or not len(r_ids):
            return q_ids, np.zeros(len(q_ids), np.int64), np.full(len(q_ids), top)
        return q_ids, radius_counts(q, r, np.ones(len(r), np.int64), radius, metric), radius_lowest(q, r, r_tag, radius, metric)

    if _fits(reference, _width(reference)):
        return broadcast_reduce(reference, query, kernel, schema, None)
    tree = BlockTree(_metric_space(reference, metric), _metric_space(query, metric), metric)
    return tree.reduce(kernel, schema, radius if metric != "cosine" else float(np.sqrt(max(0.0, 2.0 * radius) + 1e-12)))


def broadcast_reduce(
    reference: DataFrame, query: DataFrame, kernel: Callable, schema: str, combine: Callable[[DataFrame], DataFrame] | None,
    block_rows: int | None = None,
) -> DataFrame:
    """The same kernel contract with the reference in every task.

    A reference beyond the broadcast bound goes in slices by hash of its id, and
    a kernel sees one slice at a time.  ``combine`` makes the result of the rows
    of all slices; it is None only where these rows are to be put together as
    they are, as lists of edges or distances.  ``block_rows`` is for kernels that
    hold no score of every pair at once.
    """
    spark = query.sparkSession
    wide = reference.count() * (_width(reference) + 2) * 8
    slices = -(-wide * 5 // (4 * broadcast_bytes(spark)))
    if slices > 1:
        out = None
        for number in range(slices):
            part = reference.where(F.pmod(F.xxhash64("i"), F.lit(slices)) == number)
            if part.isEmpty():
                continue
            found = _reduce_slice(part, query, kernel, schema, block_rows)
            out = found if out is None else out.unionByName(found)
    else:
        out = _reduce_slice(reference, query, kernel, schema, block_rows)
    return out if combine is None else combine(out)


def _reduce_slice(reference: DataFrame, query: DataFrame, kernel: Callable, schema: str, block_rows: int | None = None) -> DataFrame:
    spark = query.sparkSession
    packed = reference.select("i", "features", "tag").toArrow()
    if packed.nbytes > 2 * broadcast_bytes(spark) + (1 << 20):
        raise LoomError("ANALYSIS_INPUT_INVALID", "reference slice exceeds the broadcast bound", bytes=packed.nbytes)
    shared = spark.sparkContext.broadcast(
        (ints(packed.column("i").combine_chunks()), matrix(packed.column("features")), ints(packed.column("tag").combine_chunks()))
    )
    tag = F.col("tag") if "tag" in query.columns else F.lit(0).cast("bigint")
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    block = block_rows or max(1, min(CHUNK_ROWS, (8 << 20) // max(1, packed.num_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r_ids, r, r_tag = shared.value
        for batch in table_batches(batches, block):
            columns = kernel(ints(batch.column("i")), matrix(batch.column("features")), ints(batch.column("tag")), r_ids, r, r_tag)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return query.select("i", "features", tag.alias("tag")).mapInArrow(run, schema)
