"""Best-fit packing of token sequences by the sum-of-squares rule.

Every document becomes token ids and one end id.  A document longer than the
capacity is cut from its end, so that only its first piece may be short.  Whole
pieces fill a sequence alone; short ones are placed, longest first, into the
open sequence for which the sum over all gaps of the squared number of open
sequences with that gap becomes smallest.  A sequence is opened only where no
open one fits.

Placement runs in shards of a bounded number of pieces.  Sequences that a shard
leaves with room are dissolved and packed again in fewer shards, until one shard
is left or nothing was gained.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, column_or_null, cut_lineage, map_rows

CAPACITY = 1024
END_ID = 2
SHARD_ITEMS = 8192
LOOSE_SHARE = 64
CACHE_WORDS = 200_000
LONG_WORD = 64
TABLE = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's only special token, which its loader reads as one id.
SPECIAL = b"<|endoftext|>"

_LOADED: dict[tuple[str, str], WordIds] = {}


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, with a table of frequent words.

    The vocabulary's splitter never joins what stands on both sides of a space
    between two other characters, so a text is encoded in parts: the first
    word, and every further one with its space.  Parts with other white space
    are encoded as they are.  The table is filled by the first words met and
    then stays; it changes the speed only.
    """

    def __init__(self, table: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            pairs = dict(line.split() for line in lines)
        merges = {base64.b64decode(piece): int(rank) for piece, rank in pairs.items()}
        self.words = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.texts = Tokenizer.from_file(table)
        self.cache: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = np.asarray(self.words.encode_ordinary(part), dtype="<u4").tobytes()
        if len(self.cache) < CACHE_WORDS and len(part) <= LONG_WORD:
            self.cache[part] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if SPECIAL in text:
            return np.asarray(self.texts.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = text.decode().split(" ")
        if not all(parts) or any(part[0].isspace() or part[-1].isspace() for part in parts):
            # A space beside other white space belongs to the part with both.
            parts = _joined_spaces(parts)
        parts[1:] = [" " + part for part in parts[1:]]
        known, new = self.cache.get, self._part
        return b"".join([known(part) or new(part) for part in parts])


def _joined_spaces(parts: list[str]) -> list[str]:
    """Undoes the splits at spaces that touch other white space or an end of the text."""
    runs: list[list[str]] = [[parts[0]]]
    for part in parts[1:]:
        before = runs[-1][-1]
        if part and before and not part[0].isspace() and not before[-1].isspace():
            runs.append([part])
        else:
            runs[-1].append(part)
    return [" ".join(run) for run in runs]


def word_ids(table: str | None = None, ranks: str | None = None) -> WordIds:
    """The encoder of this worker, made once."""
    import public_tokenizers

    paths = (table or public_tokenizers.path(TABLE), ranks or public_tokenizers.path(RANKS))
    if paths not in _LOADED:
        _LOADED[paths] = WordIds(*paths)
    return _LOADED[paths]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, table: str | None = None, ranks: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: one row per piece of every row.

    A null or empty text is its end id alone.  Repeated rows are pieces of
    their own, a null id stays null, and other columns are not read.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(table, ranks)
        for batch in batches:
            owner, number, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                value = text.as_py()
                ids = (encoder.encode(value) if value else b"") + end
                total = len(ids) // 4
                pieces = -(-total // capacity)
                first = total - capacity * (pieces - 1)
                for k in range(pieces):
                    start = 0 if k == 0 else first + capacity * (k - 1)
                    length = first if k == 0 else capacity
                    owner.append(row)
                    number.append(k)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), binary_text())
    return map_rows(rows, work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in it, and room the bin is left with, for lengths below the capacity.

    Moving one bin from gap ``g`` to ``g - s`` changes the sum of squares by
    ``2 * (open[g - s] - open[g]) + 2``, one less where the bin becomes full.
    Ties take the smallest gap, then the bin opened last.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    room: list[int] = []
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        after, before = count[: capacity - size], count[size:capacity]
        change = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
        if len(change) and before[0] > 0:
            change[0] -= 1
        rest = int(change.argmin()) if len(change) else 0
        if len(change) and before[rest] > 0:
            chosen = open_bins[size + rest].pop()
            count[size + rest] -= 1
        else:
            chosen, rest = len(room), capacity - size
            room.append(capacity)
        offsets[item], bins[item] = capacity - room[chosen], chosen
        room[chosen] = rest
        if rest:
            open_bins[rest].append(chosen)
            count[rest] += 1
    return bins, offsets, np.asarray(room, dtype=np.int64)[bins] if len(lengths) else bins


def _packed_shards(items: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """``_row, length, _level, _shard, _bin, offset, _room``; a shard's rows meet in one task."""

    def pack(table: pa.Table) -> pa.Table:
        # Ordered by row, so that the order in which a shuffle delivers rows plays no part.
        table = table.sort_by("_row")
        bins, offsets, room = sum_of_squares(table.column("length").to_numpy(), capacity)
        return pa.table({
            "_row": table.column("_row"), "length": table.column("length"), "_level": pa.array(np.full(len(bins), level), pa.int32()),
            "_shard": table.column("_shard"), "_bin": pa.array(bins), "offset": pa.array(offsets), "_room": pa.array(room),
        })

    spread = items.select("_row", "length", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(shards)).cast("bigint").alias("_shard"))
    return spread.groupBy("_shard").applyInArrow(
        pack, "_row bigint, length bigint, _level int, _shard bigint, _bin bigint, offset bigint, _room bigint"
    )


def place(pieces: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    An empty table gives an empty one.  Rows are told apart by their place in a
    checkpoint, so equal rows are packed as rows of their own.
    """
    fixed = cut_lineage(pieces).withColumn("_row", F.monotonically_increasing_id())
    items = fixed.where(F.col("length") < capacity).select("_row", "length")
    waiting, level, placed = items.count(), 0, None
    while True:
        shards = max(1, -(-waiting // shard_items))
        packed = cut_lineage(_packed_shards(items, shards, level, capacity))
        loose = F.col("_room") * LOOSE_SHARE > capacity
        tight = packed if shards == 1 else packed.where(~loose)
        placed = tight if placed is None else placed.unionByName(tight)
        if shards == 1:
            break
        items = packed.where(loose).select("_row", "length")
        left = items.count()
        if left > waiting // 2:
            # Sequences of this material stay loose; another pass would gain little.
            placed = placed.unionByName(packed.where(loose))
            break
        waiting, level = left, level + 1
    # Levels and shards are far below 2^8 and 2^27, bins of a shard below 2^shard_items bits.
    number = F.col("_level").cast("bigint") * (1 << 55) + F.col("_shard") * (1 << 28) + F.col("_bin")
    spots = placed.select("_row", number.alias("sequence_id"), "offset")
    whole = fixed.where(F.col("length") >= capacity)
    alone = whole.select(*pieces.columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    short = fixed.where(F.col("length") < capacity).join(spots, "_row").select(*pieces.columns, "sequence_id", "offset")
    return short.unionByName(alone)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every row's pieces."""
    return place(token_pieces(docs, capacity, end_id), capacity, shard_items)
