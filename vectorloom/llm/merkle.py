"""A Merkle manifest whose proofs are spread by a butterfly exchange.

Leaves stand in an order within their tree and are cut into aligned blocks of
``FANOUT ** levels`` leaves; a block is the partition of the exchange.  A task
folds its block to one digest.  Then, round by round, aligned groups of FANOUT
blocks' subtrees swap digests: the block at offset ``m`` of one subtree meets
the blocks at offset ``m`` of its siblings, each hashes the common ancestor for
itself and notes the siblings it met.  After the last round every block holds
the tree's root and the upper part of its leaves' proofs, with no pass back down.

In a last subtree of fewer blocks, block ``j`` of ``s`` answers for all offsets
equal to ``j`` modulo ``s``, so a meeting never has more than FANOUT digests
whatever the tree's size.  Leaves cross the network twice, as digests; texts never.

The trees' roots are leaves of one more tree, built by the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, cut_lineage

FANOUT = 3
# A block of 3^7 = 2187 leaves is what a task folds at a time.
BLOCK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
KINDS = {"doc_id": "bigint", "n_chars": "bigint"}
STEP = "array<struct<before:string,after:string>>"


def digest(value: Column) -> Column:
    """Lowercase hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def record_digest(columns: Sequence[Column]) -> Column:
    """Digest of the columns' values in turn: ``-`` for null, else byte count, colon, value."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return digest(F.concat(*parts))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``place``, the 0-based place of a row in its ``tree``, and ``leaves``, the tree's size.

    All rows are sorted over all tasks by tree, ``order`` and a salt that parts
    rows equal in both, which are interchangeable.  A table with a row per
    partition and tree says how many rows of the tree lie in earlier partitions.
    """
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    ranged = cut_lineage(salted.orderBy("tree", *order, "_salt").drop("_salt"))
    numbered = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    runs = numbered.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        "tree", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("leaves"),
    )
    found = numbered.join(offsets, ["tree", "_part"])
    return found.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def levels_of(leaves: int) -> int:
    """How many times the nodes of a level become their parents until one is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FANOUT), levels + 1
    return levels


def fold(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level from the leaves up, ``levels`` steps; a run of one is hashed too."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([sha256("".join(below[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(below), FANOUT)])
    return found


def _block_roots(blocked: DataFrame, levels: int) -> DataFrame:
    """``tree, block, blocks, digest`` for each block."""

    def work(block: pa.Table) -> pa.Table:
        leaves = block.column("leaves")[0].as_py()
        nodes = [node for _, node in sorted(zip(block.column("place").to_pylist(), block.column("leaf").to_pylist()))]
        top = fold(nodes, min(levels, levels_of(leaves)))[-1][0]
        blocks = -(-leaves // FANOUT**levels)
        return pa.table({"tree": block.column("tree")[:1], "block": block.column("block")[:1], "blocks": pa.array([blocks], pa.int64()), "digest": pa.array([top])})

    return blocked.select("tree", "block", "place", "leaves", "leaf").groupBy("tree", "block").applyInArrow(work, "tree string, block bigint, blocks bigint, digest string")


def butterfly(blocks: DataFrame) -> DataFrame:
    """``tree, block, upper, root`` from ``tree, block, blocks, digest``.

    A round moves each block's digest to the few offsets it answers for, so a
    round costs as many rows as there are blocks, twice at most.
    """
    state = blocks.withColumn("upper", F.lit(None).cast(STEP)).withColumn("upper", F.coalesce("upper", F.array().cast(STEP)))
    state = cut_lineage(state)
    most = state.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        subtree = F.floor(F.col("block") / width)
        group = F.floor(subtree / FANOUT)
        # Offsets that the group's first subtree, the widest, has blocks for, and those of this block's own.
        group_width = F.least(F.lit(width), F.col("blocks") - group * width * FANOUT)
        own_width = F.least(F.lit(width), F.col("blocks") - subtree * width)
        sent = state.withColumn("_group", group).withColumn("_slot", subtree - group * FANOUT).withColumn("_own", F.col("block") - subtree * width)
        meeting = F.explode(F.sequence(F.col("_own"), group_width - 1, own_width))
        sent = sent.withColumn("_width", own_width).withColumn("_meeting", meeting)
        met = sent.groupBy("tree", "_group", "_meeting").agg(
            F.array_sort(F.collect_list(F.struct("_slot", "digest", (F.col("_own") == F.col("_meeting")).alias("home"), "block", "blocks", "upper"))).alias("_met"),
            F.max("blocks").alias("_all"),
        )
        # A tree that was one subtree before this round has its root already.
        done = F.col("_all") <= width
        parent = F.when(done, F.col("_met")[0]["digest"]).otherwise(digest(F.array_join(F.transform("_met", lambda x: x["digest"]), "")))
        met = met.withColumn("_parent", parent).withColumn("_mine", F.explode(F.filter("_met", lambda x: x["home"])))

        def joined(below: bool) -> Column:
            slot = F.col("_mine._slot")
            kept = F.filter("_met", lambda x: (x["_slot"] < slot) if below else (x["_slot"] > slot))
            return F.array_join(F.transform(kept, lambda x: x["digest"]), "")

        step = F.array(F.struct(joined(True).alias("before"), joined(False).alias("after")))
        upper = F.when(done, F.col("_mine.upper")).otherwise(F.concat("_mine.upper", step))
        state = met.select("tree", F.col("_mine.block").alias("block"), F.col("_mine.blocks").alias("blocks"), F.col("_parent").alias("digest"), upper.alias("upper"))
        state = cut_lineage(state)
        width *= FANOUT
    return state.select("tree", "block", "upper", F.col("digest").alias("root"))


def beside(places: range, nodes: list[str], levels: int) -> tuple[list[list[str]], list[list[str]]]:
    """For each leaf of a block the digests before, and after, its ancestors, level by level."""
    built = fold(nodes, levels)
    before, after = [], []
    for at in places:
        left, right = [], []
        for level in range(levels):
            run = at - at % FANOUT
            row = built[level]
            left.append("".join(row[run:at]))
            right.append("".join(row[at + 1 : run + FANOUT]))
            at //= FANOUT
        before.append(left)
        after.append(right)
    return before, after


def blocks_of(rows: DataFrame, order: Sequence[str], levels: int = BLOCK_LEVELS) -> DataFrame:
    """The rows with their ``place``, their tree's ``leaves`` and their ``block``."""
    return placed(rows, order).withColumn("block", F.floor(F.col("place") / FANOUT**levels))


def with_proofs(blocked: DataFrame, upper: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The blocked rows with the columns of their block in ``upper`` and ``proof``.

    The proof holds the digests before and after the leaf's ancestors, from
    below: those inside the block, worked out here, then those the block met.
    """
    own = [c for c in blocked.columns if c not in ("block", "place", "leaves")]
    given = [c for c in upper.columns if c not in ("tree", "block", "upper")]
    kinds = dict(blocked.dtypes) | dict(upper.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*own, *given)], f"proof {STEP}"])

    def work(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        leaves, n = block.column("leaves")[0].as_py(), block.num_rows
        before, after = beside(range(n), block.column("leaf").to_pylist(), min(levels, levels_of(leaves)))
        rest = above.column("upper")[0].as_py()
        left = [x for steps in before for x in (*steps, *[s["before"] for s in rest])]
        right = [x for steps in after for x in (*steps, *[s["after"] for s in rest])]
        depth = len(left) // n
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["before", "after"])
        proofs = pa.ListArray.from_arrays(pa.array(range(0, (n + 1) * depth, depth) if depth else [0] * (n + 1), pa.int32()), steps)
        alike = [pa.array([above.column(c)[0].as_py()] * n, above.schema.field(c).type) for c in given]
        return pa.table([*[block.column(c) for c in own], *alike, proofs], names=[*own, *given, "proof"])

    return blocked.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(work, schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the digests beside its ancestors give."""
    return F.aggregate(proof, leaf, lambda node, step: digest(F.concat(step["before"], node, step["after"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all the proof's digests, from below and from left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""))


def source_key(docs: DataFrame) -> Column:
    """The name of a source's tree: a mark before the source; rows without one are first and apart from an empty name."""
    source = column_or_null(docs, "source", "string")
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def leaf_digest(docs: DataFrame, **changed: Column) -> Column:
    """A row's leaf: the digest of its fields, some given in place of the table's."""
    return record_digest([changed.get(name, column_or_null(docs, name, KINDS.get(name, "string"))) for name in FIELDS])


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS, **carried: Column) -> DataFrame:
    """``doc_id, tree, leaf, subroot, root, proof`` and the carried columns, a row for each row.

    A source's leaves ascend by id, null ids first, equal ids by their leaf;
    rows without a source are one tree, the first.  Repeated rows are a leaf
    each, and which of them stands first makes no difference.  Columns that the
    table lacks count as null, others are not read.  No rows give no rows.
    """
    # The rows are read three times below, their texts once.
    leaves = cut_lineage(docs.select(
        source_key(docs).alias("tree"), column_or_null(docs, "doc_id", "bigint"), leaf_digest(docs).alias("leaf"), *[c.alias(n) for n, c in carried.items()]
    ))
    blocked = blocks_of(leaves, ["doc_id", "leaf"], levels)
    lower = butterfly(_block_roots(blocked, levels)).withColumnRenamed("root", "subroot")
    subroots = cut_lineage(lower.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("leaf")))
    tops = blocks_of(subroots, ["name"], levels)
    named = with_proofs(tops, butterfly(_block_roots(tops, levels)), levels).select(F.col("name").alias("tree"), "root", "proof")
    upper = lower.join(named, "tree").select("tree", "block", "subroot", "root", F.concat("upper", "proof").alias("upper"))
    return with_proofs(blocked, upper, levels).select("doc_id", "tree", "leaf", "subroot", "root", "proof", *carried)


def checked(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest of the rows, and what folding a tampered copy of each gives.

    Tampering deletes the line feeds of the texts of ids whose crc32, as
    decimal text, is even; rows without an id or text are not tampered.
    ``verified`` says whether the copy still leads to the root.
    """
    doc_id, text = column_or_null(docs, "doc_id", "bigint"), column_or_null(docs, "text", "string")
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even & text.contains("\n"), leaf_digest(docs, text=F.replace(text, F.lit("\n"), F.lit(""))))
    found = manifest(docs, levels, tampered=tampered).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
