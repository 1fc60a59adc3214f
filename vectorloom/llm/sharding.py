"""Shards by jump consistent hashing, with slots inside each shard.

A row's key decides its shard with the shard count alone: a linear congruential
stream seeded by the key's hash gives the shard numbers at which the key would
move as shards are appended, and the last one below the count is the shard.  No
ring table exists, and one more shard takes rows from all others and none
moves between them.

All of it is column expressions.  The stream's 64-bit products are made of
16-bit and 32-bit parts, as SQL integers must not overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, cut_lineage

SHARDS = 16
COPIES_A_CHUNK = 10_000

# The multiplier of the published stream, and the longest walk
# that is followed; a walk takes ln(shards) steps on average, and one of 128
# steps has a chance below 10^-60 for any count that fits 31 bits.
MULTIPLIER = 2862933555777941757
LONGEST_WALK = 128

_LOW = (1 << 32) - 1
_M_LOW, _M_HIGH = MULTIPLIER & _LOW, MULTIPLIER >> 32


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _low_product(a: Column, factor: int) -> Column:
    """``a * factor`` for 32-bit values, right in its lowest 32 bits and below 2^49."""
    upper = (F.shiftright(a, 16) * _long(factor)).bitwiseAND(_long(0xFFFF))
    return a.bitwiseAND(_long(0xFFFF)) * _long(factor) + F.shiftleft(upper, 16)


def _advanced(high: Column, low: Column) -> tuple[Column, Column]:
    """The next state of the stream, ``state * MULTIPLIER + 1`` modulo 2^64, as two halves."""
    upper = F.shiftright(low, 16) * _long(_M_LOW)
    whole = low.bitwiseAND(_long(0xFFFF)) * _long(_M_LOW) + F.shiftleft(upper.bitwiseAND(_long(0xFFFF)), 16) + _long(1)
    carry = F.shiftright(whole, 32) + F.shiftright(upper, 16)
    next_high = carry + _low_product(high, _M_LOW) + _low_product(low, _M_HIGH)
    return next_high.bitwiseAND(_long(_LOW)), whole.bitwiseAND(_long(_LOW))


def jump_walk(key: Column, shards: int) -> Column:
    """Struct of the ``shard`` for so many shards and the ``grown`` one for one more."""

    def step(state: Column, _: Column) -> Column:
        high, low = _advanced(state["high"], state["low"])
        there = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("bigint")
        moved = F.struct(high.alias("high"), low.alias("low"), state["next"].alias("shard"), there.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_long(_LOW)).alias("low"), _long(-1).alias("shard"), _long(0).alias("next")
    )
    # The walk's next stop is beyond the count; where it is the count itself, one more shard takes the row.
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(min(shards, LONGEST_WALK))), start, step,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), F.when(s["next"] == shards, F.lit(shards)).otherwise(s["shard"]).cast("int").alias("grown")),
    )


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    A null text counts as the empty one; rows without an id share one key.
    Slots follow the order of a hash of the row, then of its values, so they
    do not depend on how the table is cut; equal rows are counted first and
    get consecutive slots, however many they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64("doc_id")
    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = cut_lineage(
        rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("_order", F.xxhash64("doc_id", "size", "text_crc32"))
        .withColumn("_walk", jump_walk(key, shards))
        .select("doc_id", "size", "text_crc32", "copies", "_order", F.col("_walk.shard").alias("shard"), F.col("_walk.grown").alias("grown_shard"))
    )
    return _expanded(_slotted(counted))


def _slotted(counted: DataFrame) -> DataFrame:
    """Adds ``_first``: the slot of each row's first copy.

    A shard is cut into equal ranges of the order hash; a range is numbered on
    its own and starts after the rows of the ranges before it.
    """
    from pyspark.sql import Window

    ranges = 1 << max(1, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    width = (1 << 64) // ranges
    ranged = counted.withColumn("_range", F.floor(F.col("_order") / F.lit(float(width))).cast("int"))
    inside = Window.partitionBy("shard", "_range").orderBy("_order", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("shard", "_range").agg(F.sum("copies").alias("_sum"))
    offsets = totals.select("shard", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    numbered = ranged.withColumn("_inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    return numbered.join(offsets, ["shard", "_range"]).withColumn("_first", F.col("_inside") + F.col("_offset"))


def _expanded(slotted: DataFrame) -> DataFrame:
    """Each copy as a row; a row with very many copies is dealt out in chunks."""
    last = F.col("copies") - 1
    chunks = slotted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), last, _long(COPIES_A_CHUNK))))
    dealt = chunks.repartition("shard", "_order", "_from")
    copy = F.explode(F.sequence(F.col("_from"), F.least(last, F.col("_from") + COPIES_A_CHUNK - 1)))
    return dealt.withColumn("_copy", copy).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_copy")).alias("slot"), "grown_shard"
    )
