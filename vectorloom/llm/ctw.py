"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with its own context tree over the bytes
before it.  A tree's node keeps how often its bit was 0 and 1; its
Krichevsky-Trofimov estimate is one opinion, what its children say together is
the other, and the weighted probability halves the two at every node of every
depth.  The weight that stays on a node's own estimate is then the posterior
chance that its context is deep enough, and a prediction mixes the estimates
along a path by these weights.  Below the deepest context that training saw,
the path ends.

A byte's probability depends on it and ``DEPTH`` bytes before it, so the model
is a table of such grams.  Counting is one pass with map-side sums.  The trees
are solved in groups that share the two nearest bytes; the two depths above
have at most 256 contexts, and their sums are the only thing the driver sees.

Scoring looks grams and words up.  The most frequent ones, up to a fixed number,
go to every worker; all others are joined, and as no frequent key is among
those, no join key is hot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, column_or_null, cut_lineage, held_out, map_rows, whole_words

DEPTH = 5
HOLD_MODULUS = 10
SMOOTHING = 0.1
# The keys every worker holds, at most; about 40 MB of words and 60 MB of grams.
HEAD_WORDS, HEAD_GRAMS = 200_000, 1 << 20
FLUSH_WORDS, FLUSH_GRAMS, CHUNK_BYTES = 200_000, 1_500_000, 500_000
# What ends a text, and stands before its first byte: no word holds it.
END = b"\n"

_HALF = math.log(0.5)
_CONTEXT = np.uint64((1 << (8 * DEPTH)) - 1)


def model_bytes(words: list[bytes]) -> bytes:
    """The bytes that are scored: words with one space between, then the end."""
    return b" ".join(words) + END


def text_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A gram for every byte of the texts in turn, and each text's number of them.

    A gram's lowest byte is the one predicted; its context stands above, the
    nearest byte on top.
    """
    pad = END * DEPTH
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(b"\0" * 7 + b"".join([pad + text for text in texts]), dtype=np.uint8)
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    wide = eight >> np.uint64(8 * (7 - DEPTH))
    grams = ((wide & _CONTEXT) << np.uint64(8)) | (wide >> np.uint64(8 * DEPTH))
    begins = np.cumsum(sizes + DEPTH) - sizes
    inner = np.ones(len(grams), dtype=bool)
    for k in range(1, DEPTH + 1):
        inner[begins - k] = False
    return grams[inner].view(np.int64), sizes


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


class _Tally:
    """Counts of words and grams of one partition, handed on when they fill up."""

    def __init__(self, training: bool):
        self.training = training
        self.words: Counter = Counter()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.waiting_bytes = 0
        self.waiting: list[bytes] = []

    def add(self, words: list[bytes]) -> None:
        self.words.update(words)
        self.words[b""] += 1
        text = model_bytes(words)
        self.waiting.append(text)
        self.waiting_bytes += len(text)
        if self.waiting_bytes >= CHUNK_BYTES:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            self.parts.append(np.unique(text_grams(self.waiting)[0], return_counts=True))
            self.held += len(self.parts[-1][0])
            self.waiting, self.waiting_bytes = [], 0
            if self.held > FLUSH_GRAMS and len(self.parts) > 1:
                self.parts = [_summed(self.parts)]
                self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return len(self.words) > FLUSH_WORDS or self.held > FLUSH_GRAMS

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._count()
        grams, times = _summed(self.parts) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        words = list(self.words)
        counts = np.fromiter(self.words.values(), dtype=np.int64, count=len(words))
        for kind, values, n in ((True, words, counts), (False, grams, times)):
            for at in range(0, len(values), 100_000):
                some, m = values[at : at + 100_000], n[at : at + 100_000]
                none = len(some)
                yield pa.record_batch(
                    [
                        pa.array(some, pa.binary()) if kind else pa.nulls(none, pa.binary()),
                        pa.nulls(none, pa.int64()) if kind else pa.array(some, pa.int64()),
                        pa.array(m if self.training else np.zeros(none, np.int64)), pa.array(m),
                    ],
                    names=["word", "gram", "n_train", "n_all"],
                )
        self.__init__(self.training)


def tallies(rows: DataFrame) -> DataFrame:
    """``word, gram, n_train, n_all``: one of word and gram is null; the empty word is the end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {False: _Tally(True), True: _Tally(False)}
        for batch in batches:
            for held, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                value = text.as_py()
                side = sides[held]
                side.add(whole_words(value.lower()) if value else [])
                if side.full():
                    yield from side.rows()
        for side in sides.values():
            yield from side.rows()

    counted = map_rows(rows, work, "word binary, gram bigint, n_train bigint, n_all bigint")
    return counted.groupBy("word", "gram").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for positive values, to about 1e-13."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    small = x < 10
    low = x[small]
    for k in range(10):
        shift[small] -= np.log(low + k)
    y = np.where(small, x + 10, x)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series + shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the weight on their own estimate."""
    both = np.logaddexp(_HALF + own, _HALF + below)
    return both, np.exp(_HALF + own - both)


class _Trees:
    """The trees below one pair of nearest bytes, down from depth 2.

    ``keys`` are sorted grams that share the pair, ``times`` their training
    counts.  Arrays ``bit`` and ``node`` have eight entries for each gram.
    """

    def __init__(self, keys: np.ndarray, times: np.ndarray, top: int = 2):
        byte = keys & 255
        shifts = np.arange(8)
        self.node = ((1 << shifts)[None, :] | (byte[:, None] >> (8 - shifts)[None, :])).ravel()
        self.bit = ((byte[:, None] >> (7 - shifts)[None, :]) & 1).ravel()
        weight = np.repeat(times, 8).astype(np.float64)
        self.places, self.zeros, self.ones, self.stay = {}, {}, {}, {}
        below = first = None
        for depth in range(DEPTH, top - 1, -1):
            context = keys >> (8 * (DEPTH - depth + 1))
            number = np.concatenate([[0], np.cumsum(context[1:] != context[:-1])])
            ids, at, place = np.unique(np.repeat(number, 8) * 256 + self.node, return_index=True, return_inverse=True)
            ones = np.bincount(place, weight * self.bit)
            zeros = np.bincount(place, weight) - ones
            own = log_estimate(zeros, ones)
            if below is None:
                level, stay = own, np.ones(len(ids))
            else:
                level, stay = _weighted(own, np.bincount(place[first], below, minlength=len(ids)))
            self.places[depth], self.zeros[depth], self.ones[depth], self.stay[depth] = place, zeros, ones, stay
            below, first = level, at
        self.top_nodes, self.top_level = self.node[first], below

    def chances(self, top: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Chance of each bit as of depth ``top``, and whether training saw the context."""
        chance = np.full(len(self.bit), np.nan)
        for depth in range(DEPTH, top - 1, -1):
            place = self.places[depth]
            zeros, ones, stay = self.zeros[depth][place], self.ones[depth][place], self.stay[depth][place]
            own = (np.where(self.bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
            mixed = np.where(np.isnan(chance), own, stay * own + (1 - stay) * chance)
            chance = np.where(zeros + ones > 0, mixed, np.nan)
        return chance, ~np.isnan(chance)


def _pair(name: str = "gram"):
    return F.shiftright(name, 8 * (DEPTH - 1)).alias("pair")


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, times = table.column("gram").to_numpy(), table.column("n_train").to_numpy()
    order = np.argsort(keys)
    return keys[order], times[order]


def near_depths(grams: DataFrame) -> dict[str, np.ndarray]:
    """Counts and weights of depths 1 and 0, from sums over the groups below them."""

    def sums(table: pa.Table) -> pa.Table:
        keys, times = _group(table)
        trees = _Trees(keys, times)
        nearest = int(keys[0]) >> (8 * DEPTH)
        return pa.table({
            "nearest": pa.array(np.full(len(trees.top_nodes), nearest), pa.int32()), "node": pa.array(trees.top_nodes, pa.int32()),
            "zeros": pa.array(trees.zeros[2]), "ones": pa.array(trees.ones[2]), "level": pa.array(trees.top_level),
        })

    parts = grams.select("gram", "n_train", _pair()).groupBy("pair").applyInArrow(sums, "nearest int, node int, zeros double, ones double, level double")
    # At most 256 bytes by 255 nodes, whatever the corpus.
    table = parts.groupBy("nearest", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("level").alias("level")).toArrow()
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    place = table.column("nearest").to_numpy(), table.column("node").to_numpy()
    for target, name in ((zeros, "zeros"), (ones, "ones"), (below, "level")):
        target[place] = table.column(name).to_numpy()
    level, stay = _weighted(log_estimate(zeros, ones), below)
    all_zeros, all_ones = zeros.sum(axis=0), ones.sum(axis=0)
    _, stay_all = _weighted(log_estimate(all_zeros, all_ones), level.sum(axis=0))
    return {"zeros": zeros, "ones": ones, "stay": stay, "all_zeros": all_zeros, "all_ones": all_ones, "stay_all": stay_all}


def gram_log10(keys: np.ndarray, times: np.ndarray, near: dict[str, np.ndarray]) -> np.ndarray:
    """Log10 of the chance of each gram's byte after its context; keys share a pair and are sorted."""
    trees = _Trees(keys, times)
    chance, seen = trees.chances()
    nearest = int(keys[0]) >> (8 * DEPTH)
    node, bit = trees.node, trees.bit
    for zeros, ones, stay in ((near["zeros"][nearest], near["ones"][nearest], near["stay"][nearest]), (near["all_zeros"], near["all_ones"], near["stay_all"])):
        z, o, s = zeros[node], ones[node], stay[node]
        own = (np.where(bit == 1, o, z) + 0.5) / (z + o + 1.0)
        chance = np.where(seen, s * own + (1 - s) * np.where(seen, chance, 0.0), own)
        # At depth 0 the estimate of an unseen node is one half, which still is a chance.
        seen = z + o > 0
        chance = np.where(seen, chance, 0.5)
    return np.log10(chance).reshape(-1, 8).sum(axis=1)


def gram_values(grams: DataFrame, near: dict[str, np.ndarray]) -> DataFrame:
    """``gram, n_all, value`` for every gram of the corpus, seen in training or not."""
    shared = grams.sparkSession.sparkContext.broadcast(near)

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("gram")
        value = gram_log10(table.column("gram").to_numpy(), table.column("n_train").to_numpy(), shared.value)
        return pa.table({"gram": table.column("gram"), "n_all": table.column("n_all"), "value": pa.array(value)})

    return grams.select("gram", "n_train", "n_all", _pair()).groupBy("pair").applyInArrow(solve, "gram bigint, n_all bigint, value double")


def frequent(table: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` keys reach, from a histogram by eighths of an octave."""
    step = F.floor(F.log2("n_all") * 8).cast("int")
    counts = sorted(((row[0], row[1]) for row in table.groupBy(step.alias("step")).count().collect()), reverse=True)
    held, least = 0, None
    for step_value, n in counts:
        held += n
        if held > most:
            break
        least = step_value
    return (1 << 62) if least is None else math.ceil(2 ** (least / 8) - 1e-9)


class _GramTable:
    """Open addressing over two flat arrays, looked up for many grams at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, np.nan)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[waiting[free]]
            # Of several for one place the last stays; the others go on.
            done = self.keys[slot] == keys[waiting]
            self.values[slot[done]] = values[waiting[done]]
            waiting, slot = waiting[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values; nan for what is not in the table."""
        slot = self._slot(keys)
        found = self.keys[slot]
        values = self.values[slot]
        open_at = np.flatnonzero((found != keys) & (found != -1))
        values[found == -1] = np.nan
        while len(open_at):
            slot_now = (slot[open_at] + 1) & ((1 << self.bits) - 1)
            slot[open_at] = slot_now
            found = self.keys[slot_now]
            values[open_at] = np.where(found == keys[open_at], self.values[slot_now], np.nan)
            open_at = open_at[(found != keys[open_at]) & (found != -1)]
        return values


_LOADED: dict[int, tuple] = {}


def _heads(value: tuple) -> tuple[dict[bytes, float], _GramTable]:
    """This worker's lookups for a broadcast value, which stays referenced with them."""
    if id(value) not in _LOADED:
        _LOADED.clear()
        words, word_values, grams, gram_values = value
        _LOADED[id(value)] = (value, dict(zip(words, word_values.tolist())), _GramTable(grams, gram_values))
    return _LOADED[id(value)][1:]


def _head_scores(rows: DataFrame, head: tuple, unseen: float) -> DataFrame:
    """Sums over frequent words and grams of each row, and lists of the others."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, grams_of = _heads(shared.value)
        for batch in batches:
            at, texts, size = 0, [], 0
            # Words are split for one chunk at a time: as objects they take many times their bytes.
            for row, text in enumerate(batch.column(2), 1):
                value = text.as_py() or b""
                texts.append(whole_words(value.lower()))
                size += len(value)
                if size >= CHUNK_BYTES or row == batch.num_rows:
                    yield chunk(batch.slice(at, row - at), texts, words_of, grams_of)
                    at, texts, size = row, [], 0

    def chunk(batch: pa.RecordBatch, texts: list[list[bytes]], words_of: dict[bytes, float], grams_of: _GramTable) -> pa.RecordBatch:
        n_tokens, n_known, base, rare_words = [], [], [], []
        for words in texts:
            words.append(b"")
            values = np.fromiter(map(words_of.get, words, repeat(math.nan)), dtype=np.float64, count=len(words))
            rare = np.flatnonzero(np.isnan(values))
            n_tokens.append(len(words))
            n_known.append(int((values > unseen).sum()))
            base.append(float(np.nansum(values)))
            rare_words.append([words[k] for k in rare.tolist()])
        grams, sizes = text_grams([model_bytes(words[:-1]) for words in texts])
        values = grams_of.find(grams)
        begins = np.cumsum(sizes) - sizes
        missing = np.isnan(values)
        score = np.add.reduceat(np.where(missing, 0.0, values), begins)
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(missing.astype(np.int32), begins))]).astype(np.int32)
        return pa.record_batch(
            [
                batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score),
                pa.array(rare_words, pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[missing])),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "grams"],
        )

    return map_rows(
        rows, work, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, words array<binary>, grams array<bigint>"
    )


def scored(docs: DataFrame, head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    A null or empty text is its end alone.  Without training rows nothing is
    known: every bit has chance one half, and the base spreads over one unseen
    token.  Null ids are those of the empty text; repeated rows count as often
    as they occur.  The sizes of the heads change the speed, not the values.
    """
    doc_id = column_or_null(docs, "doc_id", "bigint")
    rows = docs.select(doc_id, (held_out(doc_id, HOLD_MODULUS) == 0).alias("held_out"), binary_text())
    counts = cut_lineage(tallies(rows))
    words = counts.where("word is not null").select("word", "n_train", "n_all")
    grams = counts.where("gram is not null").select("gram", "n_train", "n_all")
    total, distinct = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.when(F.col("n_train") > 0, 1))).first()
    mass = total + SMOOTHING * (distinct + 1)
    worth = words.withColumn("value", F.log10((F.col("n_train") + F.lit(SMOOTHING)) / F.lit(mass)))
    unseen = math.log10(SMOOTHING / mass) + 1e-9
    values = cut_lineage(gram_values(grams, near_depths(grams)))
    least_word, least_gram = frequent(worth, head_words), frequent(values, head_grams)
    top_words = worth.where(F.col("n_all") >= least_word).select("word", "value").toArrow()
    top_grams = values.where(F.col("n_all") >= least_gram).select("gram", "value").toArrow()
    head = (
        top_words.column("word").to_pylist(), top_words.column("value").to_numpy(),
        top_grams.column("gram").to_numpy().copy(), top_grams.column("value").to_numpy().copy(),
    )
    found = cut_lineage(_head_scores(rows, head, unseen)).withColumn("_row", F.monotonically_increasing_id())
    rare_words = found.select("_row", F.explode("words").alias("word")).join(worth.where(F.col("n_all") < least_word), "word")
    rare_grams = found.select("_row", F.explode("grams").alias("gram")).join(values.where(F.col("n_all") < least_gram), "gram")
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    parts = rare_words.select("_row", F.col("value").alias("b"), (F.col("n_train") > 0).cast("bigint").alias("k"), zero.alias("s")).unionByName(
        rare_grams.select("_row", zero.alias("b"), none.alias("k"), F.col("value").alias("s"))
    )
    sums = parts.groupBy("_row").agg(F.sum("b").alias("_base"), F.sum("k").alias("_known"), F.sum("s").alias("_score"))
    return found.join(sums, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", none)).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("_score", zero)).alias("score"),
    )
