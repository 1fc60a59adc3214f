"""Quality rules: plain bounds, then robust multivariate outliers per language and source.

Every text gives a vector of transformed statistics.  For each language and
source the minimum-covariance-determinant estimate describes the ordinary texts:
starting at the medians and absolute deviations, concentration steps take the
three quarters of the rows nearest by Mahalanobis distance and estimate mean and
covariance anew.  A row far from its group by that distance is rejected.

The rows stay distributed: a step is one distance per row, an approximate
quantile and sums per group, all of which combine before the shuffle.  A group
of any size is never in one task.  Groups with too few rows share an estimate
with the others of their language, or with all others; where even those are too
few, nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, cut_lineage, map_rows, shielded, unshielded, whole_words

LEAST_WORDS = 50
MOST_REPEATED = 50
COVERED = 0.75
STEPS = 6
SETTLED = 1e-4
LEAST_ROWS = 100
# A group's rows are dealt out over so many parts wherever its estimate is joined to them.
PARTS = 64

# The vector's entries, and what spread each has at least: finer differences tell nothing.  Each is so
# small that its statistic alone can pass CUT: repeats reach sqrt(0.5) within the base rule, shares 1.
STATISTICS = {
    "word_length": 0.05, "symbols": 0.06, "capitals": 0.06, "marks": 0.06, "digits": 0.12, "repeats": 0.11, "same_lines": 0.14,
}
SIZE = len(STATISTICS)
# A squared distance over this is rejected: the chi-square point of 7 degrees with 1e-5 beyond.
CUT = 35.3
# Fixed value: the median of the chi-square distribution of 7 degrees.
MEDIAN = 6.346

SYMBOLS = b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(chars)] = 1
    return table


# One row per count: code points that are no blanks, symbols, capitals, other ASCII marks, digits.
_COUNTS = np.stack([
    1 - _table(bytes(range(0x80, 0xC0)) + b" \t\n\v\f\r"),
    _table(SYMBOLS),
    _table(bytes(range(65, 91))),
    _table(bytes(c for c in range(33, 127) if not chr(c).isalnum())),
    _table(b"0123456789"),
])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.asarray([numbers.setdefault(word, len(numbers)) for word in words], dtype=np.int64)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[place] > 1
    inside = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        inside[shift : shift + len(twice)] |= twice
    return int(np.count_nonzero(inside))


def text_statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the vector."""
    words = whole_words(text)
    if not words:
        return [0] * 5, [0.0] * SIZE
    chars, symbols, capitals, marks, digits = (_COUNTS @ np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)).tolist()
    lines = [line for line in text.split(b"\n") if line.strip()]
    same = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    share = np.sqrt([symbols / chars, capitals / chars, marks / chars, digits / chars, repeats / len(words), same / len(lines)])
    return [len(words), chars, symbols, same, repeats], [float(np.log(chars / len(words))), *share.tolist()]


def measured(docs: DataFrame) -> DataFrame:
    """The documents' counts, vector and group keys, all their columns beside them not read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_statistics(text.as_py()) for text in batch.column(2)]
            counts = np.asarray([counts for counts, _ in found], dtype=np.int64)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *[pa.array(counts[:, k]) for k in range(5)], pa.array([x for _, x in found], pa.list_(pa.float64()))],
                names=["_row", "pair", *COUNTED, "x"],
            )

    lang, source = column_or_null(docs, "lang", "string"), column_or_null(docs, "source", "string")
    # Null parts are left out of the text, so they differ from empty ones.
    pair = F.to_json(F.struct(lang, source)).alias("pair")
    carried = F.struct(column_or_null(docs, "doc_id", "bigint"), *row_hashes(docs)).alias("_row")
    rows = docs.select(carried, pair, F.col("text").cast("string").cast("binary").alias("text"))
    kinds = ", ".join(f"{name} bigint" for name in COUNTED)
    found = map_rows(rows, work, f"_row struct<doc_id: bigint, h1: bigint, h2: bigint>, pair string, {kinds}, x array<double>")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("part", F.pmod(F.col("_row.h1"), F.lit(PARTS)).cast("int"))


COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _beside(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins a table with one row per key; a hot key's rows go to ``PARTS`` tasks."""
    copies = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.join(copies, [key, "part"], how)


def with_cells(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Adds ``cell``, the group whose estimate a row is held against; null where all are too few."""
    sizes = rows.groupBy("pair").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    lang = F.concat(F.lit("of "), F.coalesce(F.get_json_object("pair", "$.lang"), F.lit("null")))
    sizes = sizes.withColumn("lang", lang)
    small = sizes.where(F.col("n") < least_rows)
    langs = small.groupBy("lang").agg(F.sum("n").alias("in_lang"))
    rest = langs.where(F.col("in_lang") < least_rows).agg(F.coalesce(F.sum("in_lang"), F.lit(0)).alias("n")).first()[0]
    last = F.lit("rest") if rest >= least_rows else F.lit(None).cast("string")
    named = sizes.join(langs, "lang", "left").select(
        "pair", F.when(F.col("n") >= least_rows, F.col("pair")).when(F.col("in_lang") >= least_rows, F.col("lang")).otherwise(last).alias("cell")
    )
    return _beside(rows, named, "pair", "left")


def _inverses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``cell, mean, spread`` (a flat covariance) to ``cell, mean, inverse, log_det``."""
    floor = np.diag(np.square(list(STATISTICS.values())))
    for batch in batches:
        inverses, dets = [], []
        for spread in batch.column(2):
            matrix = np.asarray(spread.as_py()).reshape(SIZE, SIZE) + floor
            inverses.append(np.linalg.inv(matrix).ravel().tolist())
            dets.append(float(np.linalg.slogdet(matrix)[1]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(inverses, pa.list_(pa.float64())), pa.array(dets)], names=["cell", "mean", "inverse", "log_det"])


def _estimate(table: DataFrame) -> DataFrame:
    return cut_lineage(map_rows(table, _inverses, "cell string, mean array<double>, inverse array<double>, log_det double"))


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from ``mean``."""
    gap = [F.col("x")[i] - F.col("mean")[i] for i in range(SIZE)]
    total = F.lit(0.0)
    for i in range(SIZE):
        total = total + F.col("inverse")[i * SIZE + i] * gap[i] * gap[i]
        for j in range(i):
            total = total + 2.0 * F.col("inverse")[i * SIZE + j] * gap[i] * gap[j]
    return total


def _started(rows: DataFrame) -> DataFrame:
    """Medians, and absolute deviations as standard deviations, by cell."""
    def median(value: Column) -> Column:
        return F.percentile_approx(value, 0.5, 1000)

    centres = cut_lineage(rows.groupBy("cell").agg(F.array(*[median(F.col("x")[i]) for i in range(SIZE)]).alias("mean")))
    spread = [F.pow(1.4826 * median(F.abs(F.col("x")[i] - F.col("mean")[i])), 2.0) for i in range(SIZE)]
    flat = F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(SIZE) for j in range(SIZE)])
    return _estimate(_beside(rows, centres, "cell").groupBy("cell").agg(F.first("mean").alias("mean"), flat.alias("spread")))


def _concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One step: mean and covariance of the nearest ``COVERED`` part of each cell."""
    far = _beside(rows, model.drop("log_det"), "cell").withColumn("_d", _distance())
    limits = far.groupBy("cell").agg(F.percentile_approx("_d", COVERED, 1000).alias("_limit"))
    near = _beside(far, limits, "cell").where("_d <= _limit")
    sums = [F.avg(F.col("x")[i]).alias(f"_m{i}") for i in range(SIZE)]
    covariances = [F.covar_pop(F.col("x")[i], F.col("x")[j]).alias(f"_c{i}_{j}") for i in range(SIZE) for j in range(i + 1)]
    moments = near.groupBy("cell").agg(*sums, *covariances)
    mean = F.array(*[F.col(f"_m{i}") for i in range(SIZE)]).alias("mean")
    spread = F.array(*[F.col(f"_c{max(i, j)}_{min(i, j)}") for i in range(SIZE) for j in range(SIZE)]).alias("spread")
    return _estimate(moments.select("cell", mean, spread))


def estimates(rows: DataFrame) -> DataFrame:
    """``cell, mean, inverse, scale`` of every cell; ``scale`` sets the median distance right."""
    model = _started(rows)
    for _ in range(STEPS):
        after = _concentrated(rows, model)
        moved = after.join(model.select("cell", F.col("log_det").alias("_old")), "cell").agg(F.max(F.abs(F.col("log_det") - F.col("_old")))).first()[0]
        model = after
        if moved is None or moved < SETTLED:
            break
    middle = _beside(rows, model, "cell").groupBy("cell").agg((F.percentile_approx(_distance(), 0.5, 1000) / MEDIAN).alias("scale"))
    return cut_lineage(model.join(middle, "cell").select("cell", "mean", "inverse", F.greatest("scale", F.lit(1.0)).alias("scale")))


def judged(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance`` for every row, and ``h1, h2``, hashes of its values.

    A null or empty text has no words and fails the base rule.  Null languages
    and sources are groups of their own.  Repeated rows are judged alike.
    ``distance`` is null where a row's group had too few rows to be described.
    """
    rows = cut_lineage(with_cells(cut_lineage(measured(docs))))
    model = estimates(rows.where(~F.col("base_failed") & F.col("cell").isNotNull()))
    far = _beside(rows, model, "cell", "left").withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return far.select(F.col("_row.doc_id").alias("doc_id"), *COUNTED, "base_failed", kept.alias("kept"), "distance", "_row.h1", "_row.h2")


def row_hashes(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's id, text, language and source."""
    parts = [column_or_null(docs, name, kind) for name, kind in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"))]
    return F.xxhash64(*parts, F.lit(1)).alias("h1"), F.xxhash64(*parts[::-1], F.lit(2)).alias("h2")


def kept_rows(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows that the rules keep, with all their columns.

    Rows with equal values are judged alike, so verdicts are joined on hashes of these.
    """
    verdicts = judged(docs, cut).where("kept").select("h1", "h2")
    own1, own2 = row_hashes(docs)
    mine = shielded(docs, own1=own1, own2=own2)
    return unshielded(mine.join(verdicts, (F.col("own1") == F.col("h1")) & (F.col("own2") == F.col("h2")), "left_semi"), docs)
