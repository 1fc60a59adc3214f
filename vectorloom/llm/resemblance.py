"""Near-duplicates by the shingles that texts share: five words each, similarity 0.8 or more.

The similarity of two texts is the size of the intersection of their shingle
sets over that of the union.  Texts with equal sets are one node.

SimHash comes first: nodes whose fingerprints of five-word shingles differ in at
most three of 64 bits are found by the covering masks, all such pairs, and each
component's nodes are compared with its leader.  A pair at similarity 0.8
differs in more bits than masks can cover, so there are further candidates:
those that share one of ``BANDS`` keys of ``BAND_ROWS`` minima each; a pair at
similarity 0.8 shares none with probability ``(1 - 0.8^5)^30``, below 1e-5, and
closer pairs less often.  Candidates are compared by their whole sets, so every
link is exact; linked nodes form components, and nodes already in one component
are not compared again.

A node is first compared with the least leader of its keys, then the nodes of a
key with the key's leader, and those left over with one of the largest component.  Links inside a component need no
comparison, so after that only nodes outside a key's largest component meet the
key's other nodes, in blocks: a large group of near copies costs rows in
proportion to its members.  A comparison reports a spanning forest of its links
rather than the pairs.  Keys that the same nodes share are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, column_or_null, cut_lineage, map_rows
from .components import components
from .simhash import keys, one_of_each, shingle_hashes, simhash
from .simhash import links as simhash_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 30
BAND_ROWS = 5
SEED = 42
BLOCK_ROWS = 128
HASH_CHUNK = 4096
# A product of two blocks takes so many shingles at a time.
COLUMN_CHUNK = 8192

_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, BANDS * BAND_ROWS), dtype=np.uint64)
_XOR, _TIMES = _MIX[0], _MIX[1] | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's shingles, each once."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS, SEED))


def _fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of all shingles, as a signed 64-bit number."""
    return int(np.uint64(simhash(hashes)).view(np.int64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit key of each band; none for no shingles."""
    if not len(shingles):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), HASH_CHUNK):
        mixed = (shingles[at : at + HASH_CHUNK, None] ^ _XOR) * _TIMES
        least = np.minimum(least, mixed.min(axis=0))
    found = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.asarray(found, dtype=np.uint64).view(np.int64).tolist()


def _node(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set; zero for no shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)) if len(shingles) else 0


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, node, fp, bands, _k1, _k2`` for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(text.as_py(), SHINGLE_WORDS, SEED) for text in batch.column(1)]
            prints, sets = pa.array([_fingerprint(h) for h in hashes], pa.int64()), [np.unique(h) for h in hashes]
            yield pa.record_batch(
                [batch.column(0), pa.array([_node(s) for s in sets], pa.int64()), prints, pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                 batch.column(2), batch.column(3)],
                names=["doc_id", "node", "fp", "bands", "_k1", "_k2"],
            )

    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), binary_text(), *keys(docs))
    return map_rows(rows, work, "doc_id bigint, node bigint, fp bigint, bands array<bigint>, _k1 bigint, _k2 bigint")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles`` for the rows ``node, _k1, _k2``; the hashes as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()).tobytes() for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    texts = docs.select(binary_text(), *keys(docs)).join(wanted, ["_k1", "_k2"]).select("node", "text")
    # Rows with equal id and text are one; the least set is any of the equal ones.
    return map_rows(texts, work, "node bigint, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left has in common with each on the right."""
    found = np.zeros((len(left), len(right)), dtype=np.float64)
    common, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    for at in range(0, len(common), COLUMN_CHUNK):
        a, b = np.searchsorted(place, [at, at + COLUMN_CHUNK])
        has = np.zeros((len(left) + len(right), min(COLUMN_CHUNK, len(common) - at)), dtype=np.float32)
        has[rows[a:b], place[a:b] - at] = 1
        found += has[: len(left)] @ has[len(left) :].T
    return found


def _forest(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, i: int, j: int) -> tuple[list[int], list[int]]:
    """Edges that span the links between block ``i`` and block ``j`` of a key."""
    left = np.flatnonzero(side == i)
    right = left if i == j else np.flatnonzero(side == j)
    if not len(left) or not len(right):
        return [], []
    shared = shared_counts([sets[k] for k in left], [sets[k] for k in right])
    sizes = np.asarray([len(s) for s in sets], dtype=np.float64)
    # Multiplied out with the numerator 4 and denominator 5 of the bound, so that no rounding decides.
    close = 5 * shared >= 4 * (sizes[left][:, None] + sizes[right][None, :] - shared)
    parent = {int(n): int(n) for n in nodes}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for p, q in np.argwhere(close).tolist():
        one, two = int(nodes[left[p]]), int(nodes[right[q]])
        x, y = root(one), root(two)
        if x != y:
            parent[max(x, y)] = min(x, y)
            a.append(one)
            b.append(two)
    return a, b


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker over rows ``band, i, j, own, node, shingles`` sorted by the first three.

    A run of equal keys is one comparison and can straddle batches; it holds at
    most two blocks of rows.
    """
    run: tuple | None = None
    held: list[tuple] = []

    def solved() -> pa.RecordBatch:
        own = np.asarray([r[0] for r in held])
        nodes = np.asarray([r[1] for r in held], dtype=np.int64)
        a, b = _forest(nodes, [np.frombuffer(r[2], dtype=np.uint64) for r in held], own, run[1], run[2])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for band, i, j, own, node, shingles in zip(*[column.to_pylist() for column in batch.columns]):
            if run != (band, i, j):
                if held:
                    yield solved()
                run, held = (band, i, j), []
            held.append((own, node, shingles))
    if held:
        yield solved()


def _compare(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges ``a, b`` of the comparisons that rows ``band, i, j, own, node`` ask for."""
    told = placed.join(sets, "node").select("band", "i", "j", "own", "node", "shingles")
    return cut_lineage(map_rows(told.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j"), _compared, "a bigint, b bigint"))


def _with_leaders(pairs: DataFrame, sets: DataFrame, block_rows: int) -> DataFrame:
    """Edges between leaders and members that are close; ``pairs`` has ``leader, node``.

    The members of a leader are dealt out in chunks of about ``block_rows``,
    each with the leader's set.
    """
    pairs = pairs.where("leader != node").distinct()
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int") + 1
    members = pairs.join(sizes, "leader").select(F.col("leader").alias("band"), F.lit(0).alias("i"), chunk.alias("j"), chunk.alias("own"), "node")
    leaders = sizes.select(
        F.col("leader").alias("band"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(1), F.col("chunks"))).alias("j"), F.lit(0).alias("own"), F.col("leader").alias("node")
    )
    return _compare(members.unionByName(leaders), sets)


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """``leader, node``: the nodes that SimHash joins, each beside the least of its component."""
    prints = nodes.select("fp").distinct()
    rooted = nodes.select("node", "fp").join(components(simhash_links(prints)).withColumnRenamed("node", "fp"), "fp", "left").select(
        "node", F.coalesce("root", "fp").alias("root"))
    led = rooted.groupBy("root").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rooted.join(led, "root").select("leader", "node").where("leader != node")


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs ``leader, node`` that the edges do not join already."""
    roots = components(edges)
    rooted = pairs.join(roots.withColumnRenamed("root", "_own"), "node", "left").join(roots.select(F.col("node").alias("leader"), F.col("root").alias("_its")), "leader", "left")
    return rooted.where(F.coalesce("_own", "node") != F.coalesce("_its", "leader")).select("leader", "node")


def _outside(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """``shared`` with ``out``, whether a node is outside its key's largest component, and the key's ``inside`` and ``outside`` counts and ``top`` node within.

    Keys without such nodes are left out.
    """
    roots = components(edges)
    rooted = shared.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    by_root = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("top"))
    largest = by_root.groupBy("band").agg(F.max(F.struct("n", "root", "top")).alias("_m"), F.sum("n").alias("_all"))
    largest = largest.select("band", F.col("_m.root").alias("main"), F.col("_m.top").alias("top"), F.col("_m.n").alias("inside"), (F.col("_all") - F.col("_m.n")).alias("outside"))
    parted = rooted.join(largest.where("outside > 0"), "band")
    return cut_lineage(parted.select("band", "node", "size", "top", "inside", "outside", (F.col("root") != F.col("main")).alias("out")))


def links(rows: DataFrame, docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``a, b`` whose components are those of all links found between nodes."""
    nodes = rows.groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("_at"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    nodes = cut_lineage(nodes.where("size(bands) > 0").select("node", "_at._k1", "_at._k2", "fp", "bands"))
    alike = cut_lineage(_by_fingerprint(nodes))
    met = nodes.select("node", F.explode("bands").alias("band"))
    sizes = met.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y")
    )
    once = sizes.where("size > 1").groupBy("size", "_x", "_y").agg(F.min(F.struct("band", "leader")).alias("_b")).select("size", "_b.band", "_b.leader")
    shared = cut_lineage(met.join(once, "band"))
    wanted = shared.select("node").unionByName(alike.select("node")).unionByName(alike.select(F.col("leader").alias("node")))
    sets = cut_lineage(_sets(docs, nodes.join(wanted.distinct(), "node", "left_semi").select("node", "_k1", "_k2")))
    edges = _with_leaders(alike, sets, block_rows)
    for pairs in (shared.groupBy("node").agg(F.min("leader").alias("leader")), shared.select("leader", "node").distinct()):
        edges = edges.unionByName(_with_leaders(_apart(pairs.where("leader != node"), edges), sets, block_rows))
    # The only pair of a key of two nodes has been compared.
    left = _outside(shared.where("size > 2").select("band", "node", "size"), edges)
    edges = edges.unionByName(_with_leaders(left.where("out").select(F.col("top").alias("leader"), "node"), sets, block_rows))
    left = _outside(left.select("band", "node", "size"), edges)
    return edges.unionByName(_compare(_block_pairs(left, block_rows), sets))


def _block_pairs(left: DataFrame, block_rows: int) -> DataFrame:
    """``band, i, j, own, node``: blocks of nodes outside meet each other and those inside.

    Blocks are numbered from zero, those outside first.
    """
    outer, inner = (F.ceil(F.col(c) / block_rows).cast("int") for c in ("outside", "inside"))
    dealt = left.withColumn("outer", outer).withColumn("inner", inner)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))).cast("int") + F.when(F.col("out"), 0).otherwise(F.col("outer")))
    met = F.when(F.col("out"), F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") - 1))
    partners = F.transform(met, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    return dealt.select("band", "own", "node", F.explode(partners).alias("_p")).select("band", "_p.i", "_p.j", "own", "node")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id.

    Rows without an id come after those with one, and of several rows with the
    least id the one with the smallest hash stays, of its id and text, then of
    its other columns.  A text of fewer than five
    words is one shingle; rows without words are one component.
    """
    rows = cut_lineage(_named(docs))
    roots = components(links(rows, docs)).withColumnRenamed("root", "_root")
    rooted = rows.join(roots, "node", "left").select("doc_id", "_k1", "_k2", F.coalesce("_root", "node").alias("root"))
    return one_of_each(docs, rooted)
