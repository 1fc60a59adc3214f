"""Ranked lexical search of all items at once, with their common subexpressions.

An item's score of a document is a sum over the item's terms, and items share
many of them.  Terms that the same items hold alike are one node; then the pair
of nodes that most items still hold is made a node of its own, again and again.
The nodes form a graph in which every item is one node at the end.  A task
works out each node once for a chunk of documents, as a vector over them, from
the two nodes it joins: partial sums are shared by all the items above them.

Scores are sums of integers, so their order makes no difference.  Items are
dealt out in blocks of bounded terms; a block's vocabulary and graph go to all
executors, the documents' term counts are read once per block.  A task reports
its best rows of each item, and the best of those are the item's.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_text, column_or_null, cut_lineage, map_rows

TOP = 20
# Terms that a block of items holds at most, repeats included; a longer item is a block of its own.
BLOCK_TERMS = 1 << 15
# Documents that a task scores at a time, and rows a task of the scoring pass takes at least.
CHUNK_DOCS = 256
TASK_DOCS = 1 << 16

# Bytes that stand in a term, A-Z lowered; all others part terms.  No byte of a
# longer UTF-8 sequence is below 128, so bytes can be judged one by one.
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The lower-cased maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_PARTS).split() if text else []


@dataclass
class Graph:
    """What a block of items asks for, in the order in which it is worked out.

    Node ``k`` below ``len(leaves)`` is ``leaves[k]``: a list of (word, times).
    The others join two earlier nodes; ``levels`` lists them so that each level
    needs only those before.  ``roots`` has an item's node, -1 for no terms.
    """

    words: list[bytes]
    leaves: list[list[tuple[int, int]]]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    nodes: int
    roots: np.ndarray


def shared_graph(items: list[list[bytes]]) -> Graph:
    """The graph of items, given as lists of terms."""
    held: dict[tuple[bytes, int], list[int]] = defaultdict(list)
    for k, words in enumerate(items):
        for word, times in Counter(words).items():
            held[word, times].append(k)
    words = sorted({word for word, _ in held})
    number = {word: k for k, word in enumerate(words)}
    # Terms that the same items hold as often are one leaf.
    alike: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
    for (word, times), where in held.items():
        alike[tuple(where)].append((number[word], times))
    sets = sorted(alike)
    leaves = [sorted(alike[where]) for where in sets]
    parts: list[set[int]] = [set() for _ in items]
    for node, where in enumerate(sets):
        for k in where:
            parts[k].add(node)
    joins: list[tuple[int, int]] = []

    def join(a: int, b: int) -> int:
        joins.append((a, b))
        return len(leaves) + len(joins) - 1

    _join_pairs(parts, join)
    roots = []
    for left in parts:
        rest = sorted(left)
        while len(rest) > 1:
            rest = [join(*rest[k : k + 2]) if k + 1 < len(rest) else rest[k] for k in range(0, len(rest), 2)]
        roots.append(rest[0] if rest else -1)
    return Graph(words, leaves, _levels(joins, len(leaves)), len(leaves) + len(joins), np.asarray(roots, dtype=np.int64))


def _join_pairs(parts: list[set[int]], join) -> None:
    """While two items or more hold a pair of nodes, puts one node in place of the pair that most hold."""
    size = 1 + max((node for nodes in parts for node in nodes), default=0)
    coded = []
    for nodes in parts:
        ordered = np.asarray(sorted(nodes), dtype=np.int64)
        a, b = np.triu_indices(len(ordered), 1)
        coded.append(ordered[a] * size + ordered[b])
    # Pairs of one item alone are most of them, and are never written out.
    code, times = np.unique(np.concatenate([*coded, np.zeros(0, dtype=np.int64)]), return_counts=True)
    often = code[times > 1]
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, own in enumerate(coded):
        for pair in own[np.isin(own, often)].tolist():
            where[divmod(pair, size)].add(k)
    queue = [(-len(held), pair) for pair, held in where.items()]
    heapq.heapify(queue)
    while queue:
        count, pair = heapq.heappop(queue)
        held = where.get(pair, ())
        if len(held) < 2:
            continue
        if -count != len(held):
            heapq.heappush(queue, (-len(held), pair))
            continue
        made = join(*pair)
        gained: dict[int, set[int]] = defaultdict(set)
        for k in sorted(held):
            for old in pair:
                parts[k].discard(old)
                for other in parts[k]:
                    if (gone := where.get((min(old, other), max(old, other)))) is not None:
                        gone.discard(k)
            for other in parts[k]:
                gained[other].add(k)
            parts[k].add(made)
        del where[pair]
        for other, both in gained.items():
            if len(both) > 1:
                where[other, made] = both
                heapq.heappush(queue, (-len(both), (other, made)))


def _levels(joins: list[tuple[int, int]], leaves: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    depth = [0] * leaves
    by_depth: dict[int, list[int]] = defaultdict(list)
    for k, (a, b) in enumerate(joins):
        depth.append(1 + max(depth[a], depth[b]))
        by_depth[depth[-1]].append(k)
    found = []
    for level in sorted(by_depth):
        at = by_depth[level]
        found.append((
            np.asarray(at, dtype=np.int64) + leaves, np.asarray([joins[k][0] for k in at], dtype=np.int64), np.asarray([joins[k][1] for k in at], dtype=np.int64)
        ))
    return found


def counted(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """``doc_id, n, at, tf``: terms of each document, and how often it has which of ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast({word: k for k, word in enumerate(words)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            sizes, offsets, at, tf = [], [0], [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                sizes.append(len(found))
                for word, times in Counter(filter(place.__contains__, found)).items():
                    at.append(place[word])
                    tf.append(times)
                offsets.append(len(at))
            ends = pa.array(offsets, pa.int32())
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                names=["doc_id", "n", "at", "tf"],
            )

    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), binary_text())
    return map_rows(rows, work, "doc_id bigint, n bigint, at array<int>, tf array<bigint>")


def term_weight(documents: int, holding: int) -> int:
    """``floor(1000 ln((2N+2) / (2df+1)))``."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def node_sums(graph: Graph, weights: np.ndarray, doc: np.ndarray, word: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Every node's sum for each document of a chunk.

    ``doc``, ``word`` and ``tf`` list the chunk's term counts; ``m`` is the
    documents' length measure.
    """
    gain = weights[word] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    by_word = np.zeros((len(graph.words), len(m)), dtype=np.int64)
    by_word[word, doc] = gain
    sums = np.zeros((graph.nodes, len(m)), dtype=np.int64)
    flat = [(w, t) for leaf in graph.leaves for w, t in leaf]
    if flat:
        rows = by_word[[w for w, _ in flat]] * np.asarray([t for _, t in flat], dtype=np.int64)[:, None]
        starts = np.cumsum([0, *[len(leaf) for leaf in graph.leaves]])[:-1]
        sums[: len(graph.leaves)] = np.add.reduceat(rows, starts, axis=0)
    for made, a, b in graph.levels:
        sums[made] = sums[a] + sums[b]
    return sums


class Best:
    """The best ``top`` rows of each item so far: highest score, then smallest id, rows without an id last."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """``scores`` has a row per item.  A row equal to the last one kept can still have a smaller id."""
        full = np.asarray([len(rows) == self.top for rows in self.rows])
        for item, doc in zip(*np.nonzero((scores > 0) & (scores >= np.where(full, self.least, 0)[:, None]))):
            row = (-int(scores[item, doc]), ids[doc] is None, ids[doc] or 0)
            rows = self.rows[item]
            if len(rows) < self.top or row < rows[-1]:
                rows.append(row)
                rows.sort()
                del rows[self.top :]
                self.least[item] = -rows[-1][0]


def _best_rows(postings: DataFrame, graph: Graph, top: int, documents: int, length: int, holding: dict[int, int]) -> DataFrame:
    """``item, score, doc_id``: each task's best rows of each of the graph's items."""
    weights = np.asarray([term_weight(documents, holding.get(k, 0)) for k in range(len(graph.words))], dtype=np.int64)
    shared = postings.sparkSession.sparkContext.broadcast((graph, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights = shared.value
        items = np.flatnonzero(graph.roots >= 0)
        best = Best(len(items), top)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(start, CHUNK_DOCS)
                sizes = part.column(1).to_numpy()
                m = 100 - 25 + (25 * sizes * documents) // length
                doc = np.repeat(np.arange(part.num_rows), np.diff(part.column(2).offsets.to_numpy()))
                word, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                best.add(node_sums(graph, weights, doc, word, tf, m)[graph.roots[items]], part.column(0).to_pylist())
        found = [(int(items[k]), -s, None if none else i) for k, rows in enumerate(best.rows) for s, none, i in rows]
        columns = list(zip(*found)) if found else [(), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item", "score", "doc_id"])

    return map_rows(postings, work, "item bigint, score bigint, doc_id bigint")


def _query_rows(items: DataFrame) -> DataFrame:
    """``item_id, _item, words``: each row of ``items`` is an item, with a number of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(text.as_py()) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "words"])

    rows = items.select(column_or_null(items, "item_id", "bigint"), binary_text())
    return map_rows(rows, work, "item_id bigint, words array<binary>").withColumn("_item", F.monotonically_increasing_id())


def _blocked(queries: DataFrame, block_terms: int) -> DataFrame:
    """Adds ``_block``; items lie by a hash, so blocks hold about half of ``block_terms``.  A long item is alone."""
    total = queries.agg(F.sum(F.size("words"))).first()[0] or 0
    alone = F.size("words") > block_terms // 16
    hashed = F.pmod(F.xxhash64("_item"), F.lit(max(1, -(-2 * total // block_terms))))
    return queries.withColumn("_block", F.when(alone, -F.col("_item") - 1).otherwise(hashed))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a score above zero.

    Equal scores are ranked by id, rows without an id last.  Every row of either
    table counts for itself, repeated ids and texts too.  Null and empty texts
    have no terms: such a document is not among the N, such an item has no rows.
    No documents or no items give no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    queries = cut_lineage(_blocked(_query_rows(items).where(F.size("words") > 0), block_terms))
    found = []
    for (block,) in queries.select("_block").distinct().orderBy("_block").collect():
        # One block is bounded by its terms, or is one item.
        asked = queries.where(F.col("_block") == block).orderBy("_item").collect()
        graph = shared_graph([[bytes(word) for word in row["words"]] for row in asked])
        postings = cut_lineage(counted(docs, graph.words))
        rows, documents, length = postings.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not documents:
            continue
        holding = {r[0]: r[1] for r in postings.select(F.explode("at").alias("w")).groupBy("w").count().collect()}
        # Term counts are small beside texts: fewer, longer tasks keep the lists of best rows few.
        tasks = max(spark.sparkContext.defaultParallelism, -(-rows // TASK_DOCS))
        best = _best_rows(postings.where("n > 0").coalesce(tasks), graph, top, documents, length, holding)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = spark.createDataFrame([(k, row["item_id"]) for k, row in enumerate(asked)], "item bigint, item_id bigint")
        placed = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).join(F.broadcast(names), "item")
        found.append(cut_lineage(placed.select("item_id", "rank", "doc_id", "score")))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)
