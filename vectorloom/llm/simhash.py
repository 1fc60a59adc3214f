"""SimHash near-duplicates, found by a covering family of bit masks.

A fingerprint's bit is one where over half of the shingle hashes have it set.
Two fingerprints are linked when at most ``radius`` bits differ.

The masks come from a linear code: bit ``i`` has a label, a vector of
``radius + 1`` bits other than zero, and mask ``v`` keeps the bits whose label
has an odd product with ``v``.  At most ``radius`` differing bits have labels
in a subspace that some ``v`` other than zero is orthogonal to; under that mask
the pair is equal.  So each linked pair meets in one of ``2^(radius+1) - 1``
tables, without chance.

Equal fingerprints are one row from the start.  What meets in a table is
compared in blocks, and a block reports a spanning forest of its links rather
than the pairs, so a bucket of any size costs bounded memory and rows in
proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_text, column_or_null, cut_lineage, map_rows, shielded, unshielded, whole_words
from .components import components

BITS = 64
RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
BLOCK_ROWS = 1024
HASH_CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words are one shingle."""
    tokens = whole_words(text.lower()) if text else []
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.asarray([digest(joined, seed)], dtype=np.uint64)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(starts))


def simhash(hashes: np.ndarray) -> int:
    """The 64 majority bits; no hashes give zero."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), HASH_CHUNK):
        part = hashes[at : at + HASH_CHUNK]
        # Most significant bit first, so that position k has weight 2^(63-k).
        spread = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += spread.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for each row, ``fp`` as a signed 64-bit number.

    A null or empty text has fingerprint zero, as the contract has it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(shingle_hashes(text.as_py())) for text in batch.column(1)]
            signed = np.asarray(values, dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])

    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), binary_text())
    return map_rows(rows, work, "doc_id bigint, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The ``2^(radius+1) - 1`` masks, as signed 64-bit numbers."""
    labels = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, labels + 1):
        mask = sum(1 << i for i in range(bits) if ((i % labels + 1) & v).bit_count() % 2)
        masks.append(mask - (1 << bits) if mask >= 1 << (bits - 1) else mask)
    return masks


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges that span what the links between two blocks connect.

    ``right`` may be ``left`` itself.  Rows already joined are not reported again.
    """
    same = right is left
    parent = np.arange(len(left) if same else len(left) + len(right))
    shift = 0 if same else len(left)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    a, b = [], []
    for i in range(len(left)):
        near = np.flatnonzero(np.bitwise_count(right ^ left[i]) <= radius)
        for j in near.tolist():
            if same and j <= i:
                continue
            x, y = root(i), root(j + shift)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(int(left[i].view(np.int64)))
                b.append(int(right[j].view(np.int64)))
    return a, b


def _bucket_edges(radius: int):
    """Worker over rows ``table, bucket, i, j, fp`` sorted by the first four.

    A run of equal keys is one comparison: block ``i`` of a bucket with itself
    or with block ``j``.  A run can straddle batches; it holds at most two
    blocks of rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def solve(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _runs_forest(columns, radius)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            key = np.stack(columns[:4])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if not len(cuts):
                held = columns
                continue
            last = int(cuts[-1]) + 1
            yield solve([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None:
            yield solve(held)

    return work


def _runs_forest(columns: list[np.ndarray], radius: int) -> tuple[list[int], list[int]]:
    key, own, fps = np.stack(columns[:4]), columns[4], columns[5].view(np.uint64)
    edges_a: list[int] = []
    edges_b: list[int] = []
    starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(fps)]]))
    # Most buckets hold two rows: these are compared all at once.
    pairs = starts[(sizes == 2) & (key[2, starts] == key[3, starts])]
    close = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius]
    edges_a += fps[close].view(np.int64).tolist()
    edges_b += fps[close + 1].view(np.int64).tolist()
    rest = (sizes > 2) | ((sizes == 2) & (key[2, starts] != key[3, starts]))
    for start, size in zip(starts[rest].tolist(), sizes[rest].tolist()):
        rows, side = fps[start : start + size], own[start : start + size]
        if key[2, start] == key[3, start]:
            a, b = _forest(rows, rows, radius)
        else:
            a, b = _forest(rows[side == key[2, start]], rows[side == key[3, start]], radius)
        edges_a += a
        edges_b += b
    return edges_a, edges_b


def links(distinct: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``a, b`` whose components are those of all links between fingerprints ``fp``.

    ``distinct`` holds each fingerprint once.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for t, m in enumerate(masks)])
    met = distinct.select("fp", F.explode(tables).alias("_t")).select("_t.table", "_t.bucket", "fp")
    sizes = met.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    shared = met.join(sizes, ["table", "bucket"]).select(
        "table", "bucket", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own")
    )
    # Block k meets blocks of every number: as the first below them, as the second above.
    partners = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")),
    )
    compared = shared.select("table", "bucket", "own", "fp", F.explode(partners).alias("_p")).select("table", "bucket", "_p.i", "_p.j", "own", "fp")
    ordered = compared.repartition("table", "bucket", "i", "j").sortWithinPartitions("table", "bucket", "i", "j", "own", "fp")
    return map_rows(ordered, _bucket_edges(radius), "a bigint, b bigint")


def _named(rows: DataFrame, radius: int) -> DataFrame:
    """``fp, component_id`` for every fingerprint of ``rows``, which have ``doc_id, fp``."""
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row.

    The component id is the smallest id of any row that a chain of links
    reaches; rows without an id count for no minimum, and a component of such
    rows alone has none.  Repeated rows are members like any other.
    """
    rows = cut_lineage(fingerprints(docs))
    named = _named(rows, radius)
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id.

    Rows without an id come after those with one, and of several rows with the
    least id the one with the smallest hash stays.  Rows without words are one
    component, as their fingerprints are equal.
    """
    rows = cut_lineage(_keyed_fingerprints(docs))
    return one_of_each(docs, rows.join(_named(rows.select("doc_id", "fp"), radius).select("fp", "root"), "fp"))


def one_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row with the smallest id of each ``root``; ``rooted`` has ``doc_id, _k1, _k2, root`` for each row."""
    # Minima combine before the shuffle, so a component of any size is one row of each task.
    chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")).alias("_best")).select("_best._k1", "_best._k2")
    k1, k2 = keys(docs)
    mine = shielded(docs, own1=k1, own2=k2)
    kept = mine.join(chosen, (F.col("own1") == F.col("_k1")) & (F.col("own2") == F.col("_k2")), "left_semi")
    # Rows with equal id and text are one choice, and lie together after the join; a hash of all columns tells them apart.
    whole = F.xxhash64(*[F.col(f"c{k}") for k, kind in enumerate(docs.dtypes) if "map<" not in kind[1]])
    number = F.row_number().over(Window.partitionBy("own1", "own2").orderBy(whole))
    return unshielded(kept.withColumn("number", number).where("number = 1"), docs)


def keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's id and text."""
    parts = [column_or_null(docs, "doc_id", "bigint"), F.col("text").cast("string")]
    return F.xxhash64(*parts, F.lit(1)).alias("_k1"), F.xxhash64(*parts[::-1], F.lit(2)).alias("_k2")


def _keyed_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, _k1, _k2`` for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(shingle_hashes(text.as_py())) for text in batch.column(1)]
            signed = np.asarray(values, dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(signed), batch.column(2), batch.column(3)], names=["doc_id", "fp", "_k1", "_k2"])

    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), binary_text(), *keys(docs))
    return map_rows(rows, work, "doc_id bigint, fp bigint, _k1 bigint, _k2 bigint")
