"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, each with a vector found
by hashing; a text is the average of its words' averages, and a softmax over two
classes reads that average.  Vectors and softmax are trained together in numpy.
A misspelling that was never seen still shares most of its n-grams with the
word, and so its vector.

Because everything behind the vectors is linear, a trained model comes down to
one number per n-gram, which is what the workers get.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, column_or_null, held_out, map_rows, whole_words

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
DIMENSIONS = 4
# Labelled texts that the fit takes of each class, at most: those first by a hash of their id.
FIT_TEXTS = 2500
EPOCHS = 15
BATCH_TEXTS = 256
RATE = 0.05
SEED = 11
# A word's share of a text is about a hundredth; the average is read at this scale.
INPUT_SCALE = 100.0
# Texts of class 0 are also shown in stretches of so many words: what is true of
# the whole is true of them, and short texts get no score by their few words.
STRETCHES = (24, 40, 40)
# Each step also shrinks the vectors it touches by so much, times the rate.
DECAY = 0.005
THRESHOLD = 0.7
# Words whose values a worker keeps, and words whose n-grams it works out at a time.
CACHE_WORDS, LEARN_WORDS = 200_000, 10_000
LONG_WORD = 64
HOLD_MODULUS, HOLD_REMAINDER = 3, 1

_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every n-gram of ``<word>``, and of each word whole.

    Owners come in ascending order.
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    joined = b"<" + b"><".join(words) + b">" + b"\0" * 8
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    raw = np.frombuffer(joined, dtype=np.uint8)
    eight = np.ndarray((int(ends[-1]),), dtype="<u8", buffer=raw, strides=(1,))
    left = np.repeat(ends, sizes) - np.arange(int(ends[-1]))
    owners, found = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        value = (eight[at] & np.uint64((1 << (8 * n)) - 1)) + (np.uint64(n) << np.uint64(56))
        owners.append(owner[at])
        found.append(value)
    # A whole word is the sum of its bytes times powers of an odd number, modulo 2^64.
    power = np.cumprod(np.full(int(sizes.max()), 1099511628211, dtype=np.uint64))
    place = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
    owners.append(np.arange(len(words)))
    found.append(np.add.reduceat(raw[: int(ends[-1])].astype(np.uint64) * power[place], ends - sizes))
    values = np.concatenate(found)
    values = (values ^ (values >> np.uint64(29))) * _MIX
    bucket = ((values ^ (values >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
    owned = np.concatenate(owners)
    order = np.argsort(owned, kind="stable")
    return owned[order], bucket[order]


def examples(text: bytes | None, label: int, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bags that a labelled text is trained on: the text, and stretches of it for class 0."""
    words = whole_words(text.lower()) if text else []
    found = [bag(words)]
    if not label:
        draw = np.random.default_rng([seed, len(words)])
        for size in STRETCHES:
            at = int(draw.integers(0, max(1, len(words) - size + 1)))
            found.append(bag(words[at : at + size]))
    return found


def bag(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, ascending, and their weights, which sum to one; no words have none."""
    counts = Counter(words)
    if not counts:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    owner, bucket = subwords(list(counts))
    share = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    share /= share.sum()
    weight = (share / np.bincount(owner))[owner]
    met, inverse = np.unique(bucket, return_inverse=True)
    return met, np.bincount(inverse, weight)


@dataclass
class Model:
    """``slope`` per bucket: what one unit of its weight adds to the log odds."""

    slope: np.ndarray
    offset: float

    def score(self, log_odds: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.offset + log_odds, -50, 50)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Joint fit of vectors and softmax by Adam on the cross-entropy.

    Without texts of both classes the model gives one half everywhere.
    """
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    head = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    lean = np.zeros(2, dtype=np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, head, lean)]
    order = rng.permutation(len(bags))
    batches = []
    for start in range(0, len(order), BATCH_TEXTS):
        chosen = order[start : start + BATCH_TEXTS]
        met, local = np.unique(np.concatenate([bags[k][0] for k in chosen]), return_inverse=True)
        weight = (INPUT_SCALE * np.concatenate([bags[k][1] for k in chosen])).astype(np.float32)
        owner = np.repeat(np.arange(len(chosen), dtype=np.int16), [len(bags[k][0]) for k in chosen])
        batches.append((met, local.astype(np.int32), weight, owner, labels[chosen]))
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            step += 1
            _update(vectors, head, lean, moments, step, *batches[k])
    slope = (vectors @ (head[:, 1] - head[:, 0])).astype(np.float64)
    return Model(slope * INPUT_SCALE, float(lean[1] - lean[0]))


def _update(vectors, head, lean, moments, step, met, local, weight, owner, labels) -> None:
    """One Adam step over a batch of bags; only vectors that occur are touched."""
    texts, own = len(labels), vectors[met]
    hidden = np.empty((texts, DIMENSIONS), dtype=np.float32)
    for d in range(DIMENSIONS):
        hidden[:, d] = np.bincount(owner, weight * own[local, d], minlength=texts)
    logits = hidden @ head + lean
    logits -= logits.max(axis=1, keepdims=True)
    chance = np.exp(logits)
    chance /= chance.sum(axis=1, keepdims=True)
    chance[np.arange(texts), labels] -= 1.0
    slope = (chance / texts).astype(np.float32)
    back = slope @ head.T
    gradient = np.empty((len(met), DIMENSIONS), dtype=np.float32)
    for d in range(DIMENSIONS):
        gradient[:, d] = np.bincount(local, weight * back[owner, d], minlength=len(met))
    for value, change, rows, (first, second) in (
        (vectors, gradient, met, moments[0]), (head, hidden.T @ slope, slice(None), moments[1]), (lean, slope.sum(axis=0), slice(None), moments[2]),
    ):
        first[rows] = 0.9 * first[rows] + 0.1 * change
        second[rows] = 0.99 * second[rows] + 0.01 * change * change
        size = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        if value is vectors:
            value[rows] *= 1 - RATE * DECAY
        value[rows] -= size * first[rows] / (np.sqrt(second[rows]) + 1e-8)


class WordSlopes(dict):
    """What each word adds to the log odds of a text that it fills; kept for the first words met."""

    def __init__(self, model: Model):
        super().__init__()
        self.slope = model.slope

    def learn(self, words: list[bytes]) -> dict[bytes, float]:
        """Values of new words; those that still fit are kept."""
        found = {}
        for at in range(0, len(words), LEARN_WORDS):
            some = words[at : at + LEARN_WORDS]
            owner, bucket = subwords(some, len(self.slope))
            found.update(zip(some, (np.bincount(owner, self.slope[bucket]) / np.bincount(owner)).tolist()))
        if len(self) + len(found) <= CACHE_WORDS:
            self.update({word: value for word, value in found.items() if len(word) <= LONG_WORD})
        return found

    def log_odds(self, texts: list[bytes | None]) -> np.ndarray:
        """Average over each text's words; 0 for a text without words."""
        split = [whole_words(text.lower()) if text else [] for text in texts]
        new = {word for words in split for word in words if word not in self}
        extra = self.learn(list(new)) if new else {}
        known = self.get
        sums = [sum([known(word) if word in self else extra[word] for word in words]) for words in split]
        return np.asarray([total / len(words) if words else 0.0 for total, words in zip(sums, split)])


_LOADED: dict[int, tuple[Model, WordSlopes]] = {}


def fit(docs: DataFrame, labels: DataFrame, texts: int = FIT_TEXTS) -> Model:
    """Learns from labelled rows that are not held out, at most ``texts`` of each class.

    A row is held out where the remainder of its id's crc32 says so.  Labels of
    null are no labels, and of several for one id the largest counts.  The rows
    taken are the first by a hash of the id, so they do not depend on the
    partitioning.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .where(F.col("_toxic").isNotNull() & F.col("_id").isNotNull() & (held_out(F.col("_id"), HOLD_MODULUS) != HOLD_REMAINDER))
        .groupBy("_id").agg((F.max("_toxic") > 0).cast("int").alias("_toxic"))
    )
    chosen = [known.where(F.col("_toxic") == side).orderBy(F.xxhash64("_id"), "_id").limit(texts) for side in (0, 1)]
    taken = F.broadcast(chosen[0].unionByName(chosen[1]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = [examples(text.as_py(), label.as_py()) for text, label in zip(batch.column(2), batch.column(1))]
            owner = pa.array(np.repeat(np.arange(len(shown)), [len(bags) for bags in shown]))
            bags = [b for found in shown for b in found]
            yield pa.record_batch(
                [
                    batch.column(0).take(owner), batch.column(1).take(owner), pa.array([k for found in shown for k in range(len(found))], pa.int32()),
                    pa.array([b[0] for b in bags], pa.list_(pa.int32())), pa.array([b[1] for b in bags], pa.list_(pa.float32())),
                ],
                names=["_id", "_toxic", "part", "at", "weight"],
            )

    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), binary_text()).join(taken, F.col("doc_id") == F.col("_id")).select("_id", "_toxic", "text")
    # Repeated documents of one id would outgrow the bound; one of each is taken.
    sample = map_rows(rows, work, "_id bigint, _toxic int, part int, at array<int>, weight array<float>").dropDuplicates(["_id", "part"])
    sample = sample.toArrow().sort_by([("_id", "ascending"), ("part", "ascending")])
    bags = [(at.values.to_numpy(), weight.values.to_numpy()) for at, weight in zip(sample["at"], sample["weight"])]
    return train(bags, sample["_toxic"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    A null or empty text has no words and gets the model's offset alone; without
    labels of both classes every score is one half.  Null ids and repeated rows
    stay as they are.  Nothing but the text is read for a score.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = (shared.value, WordSlopes(shared.value))
        own, slopes = _LOADED[key]
        for batch in batches:
            score = own.score(slopes.log_odds([text.as_py() for text in batch.column(2)]))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = column_or_null(docs, "doc_id", "bigint")
    rows = docs.select(doc_id, (held_out(doc_id, HOLD_MODULUS) == HOLD_REMAINDER).alias("held_out"), binary_text())
    return map_rows(rows, work, "doc_id bigint, held_out boolean, score double, predicted int")
