"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots, each holding one block of equally many words.
Slot ``t`` has the van der Corput point of ``t``; the sources' quotas of blocks,
laid end to end, are cumulative weights, and the source in whose stretch the
point falls fills the slot.  Points beyond the last stretch leave no slot.  So
every source gets just its quota, spread evenly over the mix.

A source's documents, in the order of a hash, are its stream of words, repeated
when it ends and cut into blocks.  A slot's rank among its source's slots is the
block it takes; a source's last block ends at its target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from .common import binary_text, column_or_null, cut_lineage, map_rows, shielded, unshielded, whole_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 1024
SLOTS_A_RANGE = 1 << 16
SEED = 17

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def count_words(text: bytes | None) -> int:
    """Words ``[^\\x20\\x09-\\x0D]+``: places where a word begins."""
    if not text:
        return 0
    space = _SPACE[np.frombuffer(text, dtype=np.uint8)]
    return int(not space[0]) + int(np.count_nonzero(space[:-1] & ~space[1:]))


def sized_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, k1, k2``: words of each row, and a hash pair of its values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([count_words(text.as_py()) for text in batch.column(2)], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), sizes, batch.column(3), batch.column(4)], names=["doc_id", "source", "size", "k1", "k2"])

    k1, k2 = row_keys(docs)
    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), column_or_null(docs, "source", "string"), binary_text(), k1, k2)
    return map_rows(rows, work, "doc_id bigint, source string, size bigint, k1 bigint, k2 bigint")


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that tell rows with different values apart."""
    parts = [column_or_null(docs, "doc_id", "bigint"), column_or_null(docs, "source", "string"), F.col("text").cast("string")]
    return F.xxhash64(F.lit(SEED), *parts).alias("k1"), F.xxhash64(*parts[::-1], F.lit(SEED)).alias("k2")


def _ranked(named: DataFrame) -> DataFrame:
    """Adds ``rank``, the 0-based place in the order of ``source``.

    The rows are sorted over all tasks; a table with one row per partition says
    how many come before it.
    """
    ordered = cut_lineage(named.orderBy("source")).withColumn("_id", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(offsets, "_part").select("source", "source_size", (F.col("_at") + F.col("_before")).cast("bigint").alias("rank"))


def source_targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """``source, rank, source_size, target``: one row per source, nulls last.

    Weights repeat in code-point order.  Targets share ``share`` of all sizes by
    weight, none above ``repeats`` times its source: that is one level times the
    weight, or the ceiling where that is lower.  The level is found by sums over
    the sources.
    """
    sizes = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    named = sizes.where("source is not null")
    ranked = _ranked(named)
    total = sizes.agg(F.sum("source_size"), F.count("source")).first()
    unnamed = sizes.where("source is null").select("source", "source_size", F.lit(total[1]).cast("bigint").alias("rank"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut_lineage(ranked.unionByName(unnamed).withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * float(repeats)))
    goal, level, full = share * float(total[0] or 0), 0.0, -1
    while True:
        at_ceiling = (F.col("ceiling") <= F.lit(level) * F.col("weight")) if full >= 0 else F.lit(False)
        capped, open_weight, count = table.agg(
            F.coalesce(F.sum(F.when(at_ceiling, F.col("ceiling"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_ceiling, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(at_ceiling, 1)),
        ).first()
        if count == full or not open_weight:
            break
        level, full = (goal - capped) / open_weight, count
    return table.select("source", "rank", "source_size", F.least("ceiling", F.lit(level) * F.col("weight")).alias("target"))


def _reversed_bits(value: Column, bits: int) -> Column:
    """The value whose ``bits`` binary digits stand in opposite order."""
    if bits == 0:
        return F.lit(0).cast("bigint")
    return F.conv(F.reverse(F.lpad(F.bin(value), bits, "0")), 2, 10).cast("bigint")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``slot, rank, block, words``: the mix's slots with their source's rank and block.

    Slots are numbered in the order of the points, with gaps.  ``words`` is the
    block's length, short only for a source's last block.
    """
    want = F.least(F.round("target"), F.col("source_size") * REPEATS).cast("bigint")
    wanted = targets.select("rank", want.alias("want")).where("want > 0").withColumn("quota", F.ceil(F.col("want") / block_words).cast("bigint"))
    placed = cut_lineage(running_totals(wanted.withColumn("_all", F.lit(0)), ["_all"], "rank", "quota"))
    total = placed.agg(F.sum("quota")).first()[0] or 0
    bits = max(0, int(total) - 1).bit_length()
    # Stretches of points are dealt out in chunks, so a source with a third of them is not one task.
    first, last = F.col("before"), F.col("before") + F.col("quota") - 1
    chunk = F.explode(F.sequence(F.floor(first / SLOTS_A_RANGE), F.floor(last / SLOTS_A_RANGE)))
    chunks = placed.select("rank", "want", "before", "quota", chunk.alias("_chunk")).repartition("rank", "_chunk")
    low, high = F.greatest(first, F.col("_chunk") * SLOTS_A_RANGE), F.least(last, F.col("_chunk") * SLOTS_A_RANGE + SLOTS_A_RANGE - 1)
    points = chunks.select("rank", "want", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))).alias("_point"))
    slots = cut_lineage(points.select("rank", "want", _reversed_bits(F.col("_point"), bits).alias("slot")))
    ranged = slots.withColumn("_range", F.floor(F.col("slot") / SLOTS_A_RANGE))
    inside = Window.partitionBy("rank", "_range").orderBy("slot")
    before = Window.partitionBy("rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("rank", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("rank", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = ranged.withColumn("_k", F.row_number().over(inside) - 1).join(offsets, ["rank", "_range"])
    block = (F.col("_k") + F.col("_offset")).cast("bigint")
    words = F.least(F.lit(block_words), F.col("want") - block * block_words).cast("bigint")
    return numbered.select("slot", "rank", block.alias("block"), words.alias("words"))


def streams(rows: DataFrame) -> DataFrame:
    """Adds ``at``: the place of each row's first word in its source's shuffled stream.

    ``rows`` has ``rank, size, k1, k2``.  A source is cut into equal ranges of the
    hash, so one with a third of the rows spreads like the rest.
    """
    ranges = 1 << max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    ranged = rows.withColumn("_range", F.floor(F.col("k1") / F.lit(float((1 << 64) // ranges))).cast("int"))
    inside = Window.partitionBy("rank", "_range").orderBy("k1", "k2", "_row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("rank", "_range").agg(F.sum("size").alias("_sum"))
    offsets = sums.select("rank", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inner = ranged.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return inner.join(offsets, ["rank", "_range"]).withColumn("at", (F.col("_inside") + F.col("_offset")).cast("bigint")).drop("_range", "_inside", "_offset")


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_row, source_size, target``, and what each slot takes of each row.

    ``rows`` is a table of ``sized_rows``.  The second table is ``slot, _row, epoch,
    first, words``: a slot takes ``words`` words of a row from its word ``first`` on.
    A row of no words is in no slot.  Empty tables give empty ones.
    """
    fixed = cut_lineage(rows).withColumn("_row", F.monotonically_increasing_id())
    targets = cut_lineage(source_targets(fixed, weights, share))
    # Null sources join too; the table of sources is small beside the rows.
    known = targets.withColumnRenamed("source", "_source")
    named = fixed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    slots = schedule(targets, block_words)
    placed = streams(named.where("size > 0").select("_row", "rank", "size", "k1", "k2", "source_size"))
    spans = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn("_begin", F.col("at") + F.col("epoch") * F.col("source_size"))
    reach = F.sequence(F.floor(F.col("_begin") / block_words), F.floor((F.col("_begin") + F.col("size") - 1) / block_words))
    covered = spans.select("_row", "rank", "epoch", "size", "_begin", F.explode(reach).alias("block"))
    met = covered.join(slots, ["rank", "block"])
    start = F.greatest(F.col("_begin"), F.col("block") * block_words)
    end = F.least(F.col("_begin") + F.col("size"), F.col("block") * block_words + F.col("words"))
    taken = met.select("slot", "_row", "epoch", (start - F.col("_begin")).alias("first"), (end - start).alias("words")).where("words > 0")
    return named, taken


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row.

    A null text has no words.  Null sources are one source, the last.  Repeated
    rows are taken on their own.
    """
    named, taken = mix(sized_rows(docs))
    sums = taken.groupBy("_row").agg(F.sum("words").alias("taken"))
    return named.join(sums, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


_BLANK = r"[\x09-\x0D\x20]"


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its word number ``count``, without blanks before its first word."""
    body = F.regexp_replace(text, f"^{_BLANK}+", "")
    parts = F.split(body, f"{_BLANK}+", (count + 1).cast("int"))
    rest = F.when(F.size(parts) > count, F.element_at(parts, (count + 1).cast("int"))).otherwise(F.lit(""))
    return F.regexp_replace(F.substring(body, F.lit(1), F.length(body) - F.length(rest)), f"{_BLANK}+$", "")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: once per time, cut where the mix ends.

    All columns stay; ``n_chars`` is counted anew where a text is cut.  A cut text
    ends after the last word taken.  Rows that the mix leaves out, and rows without
    words, go.  What is taken is told apart by hashes of a row's values; of equal
    rows each takes the share of one.
    """
    named, taken = mix(sized_rows(docs))
    times = taken.groupBy("_row", "epoch").agg(F.sum("words").alias("words")).groupBy("_row").agg(F.sort_array(F.collect_list("words"), asc=False).alias("_words"))
    shares = named.select("_row", "k1", "k2", "size").join(times, "_row")
    # Equal rows follow each other in a stream, so few different shares fall to them; runs say to how many each.
    runs = shares.groupBy("k1", "k2", "size", "_words").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("k1", "k2").orderBy(F.desc("_words")))
    listed = runs.withColumn("_upto", upto).groupBy("k1", "k2", "size").agg(F.array_sort(F.collect_list(F.struct("_upto", "_words"))).alias("_runs"))
    own1, own2 = row_keys(docs)
    mine = shielded(docs, own1=own1, own2=own2)
    met = mine.join(listed, (F.col("own1") == F.col("k1")) & (F.col("own2") == F.col("k2")))
    met = met.withColumn("_copy", F.row_number().over(Window.partitionBy("own1", "own2").orderBy("own1")))
    own = F.filter("_runs", lambda r: r["_upto"] >= F.col("_copy"))
    each = met.withColumn("_take", F.explode(F.when(F.size(own) > 0, F.element_at(own, 1)["_words"])))
    # A cut text is its first words with what stands between them.
    whole, text = F.col("_take") >= F.col("size"), F.col(f"c{docs.columns.index('text')}")
    cut = F.when(whole, text).otherwise(first_words(text, F.col("_take")))
    changed = {f"c{docs.columns.index('text')}": cut}
    if "n_chars" in docs.columns:
        chars = f"c{docs.columns.index('n_chars')}"
        changed[chars] = F.when(whole, F.col(chars)).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return unshielded(each.withColumns(changed), docs)
