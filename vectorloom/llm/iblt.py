"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is a set of paragraph digests: lines, and of lines over ``CUT_WORDS``
words every so many words, so that a text without line breaks compares too.
The k-th copy of a paragraph has a digest of its own.  A sketch puts each digest
into three cells; a cell holds how many it has, the exclusive or of the
digests, and that of a check of each.  Two sketches subtract cell by cell, what
both texts have cancels, and peeling recovers the rest: a cell with one digest
gives it away, it is taken out of its other cells, and so on.

Cells are in groups by a hash of the digest, one group for every few digests of
the two texts, so that the work grows with the text.  A group is first sized for
what is expected of the pair; one that does not peel is made anew at about twice
the size, until all are recovered.

All of it is column expressions, grouped sums and higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, cut_lineage

CUT_WORDS = 16
BASE_CELLS = 4
GROUP_DIGESTS = 16
# Cells in each third of a group, at first: for texts that share half, and for those that share nothing.
HALF_CELLS, FULL_CELLS = 6, 14
ROUNDS = 24
RANGES_A_PARTITION = 4
MOST_RANGES = 2048

_UNIT = r"(?:[^ \n]++ *+){1,%d}+\n?|[ \n]+" % CUT_WORDS


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs; null gives none."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_UNIT), F.lit(0))

    def told_apart(hashes: Column) -> Column:
        copies = F.transform(hashes, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(hashes, h).cast("int")))
        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.transform(hashes, lambda h: F.xxhash64(h, F.lit(0)))).otherwise(copies)

    return _bound(F.sort_array(F.transform(units, lambda u: F.xxhash64(u))), told_apart)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit(3), digest).bitwiseAND(F.lit((1 << 32) - 1))


def _places(digest: Column, cells: Column) -> Column:
    """The three cells of a digest, one in each third of ``3 * cells``."""
    mixed = F.xxhash64(F.lit(5), digest)
    return F.array(
        F.pmod(mixed, cells).cast("int"),
        (cells + F.pmod(F.shiftright(mixed, 21), cells)).cast("int"),
        (2 * cells + F.pmod(F.shiftright(mixed, 42), cells)).cast("int"),
    )


def sketches(jobs: DataFrame) -> DataFrame:
    """``_row, kind, group, cells, sketch``: one sketch per group of every job.

    ``jobs`` has ``_row, kind, left, right, groups, cells, only`` and lies together
    by ``_row``; the left digests count one, the right ones minus one.  ``only``
    lists the groups to make; null means all.
    """
    signed = F.concat(
        F.transform("left", lambda d: F.struct(d.alias("digest"), F.lit(1).alias("n"))),
        F.transform("right", lambda d: F.struct(d.alias("digest"), F.lit(-1).alias("n"))),
    )
    each = jobs.select("_row", "kind", "groups", "cells", "only", F.explode(signed).alias("_s")).select(
        "_row", "kind", "cells", "only", F.pmod(F.xxhash64(F.lit(7), F.col("_s.digest")), F.col("groups")).cast("int").alias("group"), "_s.digest", "_s.n"
    )
    return cells_of(each.where(F.col("only").isNull() | F.array_contains("only", F.col("group"))).drop("only"))


def cells_of(each: DataFrame) -> DataFrame:
    """The sketches of rows ``_row, kind, cells, group, digest, n``.

    Cells that stay empty are rows of zeros, so a sketch is whole.
    """
    placed = each.select(
        "_row", "kind", "cells", "group", F.explode(_places(F.col("digest"), F.col("cells"))).alias("cell"),
        "n", F.col("digest").alias("key"), _check(F.col("digest")).alias("check"),
    )
    summed = placed.groupBy("_row", "kind", "cells", "group", "cell").agg(
        F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")
    )
    listed = summed.groupBy("_row", "kind", "cells", "group").agg(F.collect_list(F.struct("cell", "n", "key", "check")).alias("some"))
    return listed.withColumn("sketch", _filled(F.col("some"), F.col("cells"))).drop("some")


def _cell(index: Column, n: Column, key: Column, check: Column) -> Column:
    return F.struct(index.cast("int").alias("cell"), n.cast("int").alias("n"), key.cast("bigint").alias("key"), check.cast("bigint").alias("check"))


def _filled(some: Column, cells: Column) -> Column:
    """All ``3 * cells`` cells in order of their number, from those that are not empty."""
    blanks = F.transform(
        F.array_except(F.sequence(F.lit(0), (3 * cells - 1).cast("int")), F.transform(some, lambda c: c["cell"])),
        lambda i: _cell(i, F.lit(0), F.lit(0), F.lit(0)),
    )
    return F.sort_array(F.concat(F.transform(some, lambda c: _cell(c["cell"], c["n"], c["key"], c["check"])), blanks))


def written(sketch: Column) -> Column:
    """A sketch as hexadecimal text: count, digest and check of every cell."""
    return F.concat_ws("", F.transform(sketch, lambda c: F.concat(
        F.lpad(F.hex(c["n"].bitwiseAND(F.lit(0xFFFF))), 4, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["check"]), 8, "0"),
    )))


def _pure(cell: Column) -> Column:
    return (F.abs(cell["n"]) == 1) & (cell["check"] == _check(cell["key"]))


def peeled(sketch: Column, cells: Column) -> Column:
    """Struct of ``whole``, and the digests ``left`` and ``right`` that only one text has."""

    def less(table: Column, place: Column, taken: Column) -> Column:
        old = F.element_at(table, place + 1)
        return F.array(_cell(place, old["n"] - taken["n"], old["key"].bitwiseXOR(taken["key"]), old["check"].bitwiseXOR(taken["check"])))

    def without(table: Column, places: Column, taken: Column) -> Column:
        # The three places ascend, so one pass over the table replaces them all.
        a, b, c = places[0], places[1], places[2]
        return F.concat(
            F.slice(table, F.lit(1), a), less(table, a, taken), F.slice(table, a + 2, b - a - 1), less(table, b, taken),
            F.slice(table, b + 2, c - b - 1), less(table, c, taken), F.slice(table, c + 2, F.size(table)),
        )

    def take(state: Column, seen: Column) -> Column:
        # One digest may be alone in several cells; the first of them takes it out of all.
        found = F.element_at(state["table"], seen["cell"] + 1)
        table = F.aggregate(F.array(_places(seen["key"], cells)), state["table"], lambda t, places: without(t, places, seen))
        side = F.array(seen["key"])
        none = F.array().cast("array<bigint>")
        return F.when((found["n"] == seen["n"]) & (found["key"] == seen["key"]), F.struct(
            table.alias("table"), F.concat(state["left"], F.when(seen["n"] == 1, side).otherwise(none)).alias("left"),
            F.concat(state["right"], F.when(seen["n"] == -1, side).otherwise(none)).alias("right"), state["alone"].alias("alone"),
        )).otherwise(state)

    def turn(state: Column, _: Column) -> Column:
        # The cells that hold one digest now; what their removal lays bare is for the next round.
        after = F.aggregate(state["alone"], state, take)
        return F.when(F.size(state["alone"]) > 0, _bound(after, lambda s: F.struct(
            s["table"].alias("table"), s["left"].alias("left"), s["right"].alias("right"), F.filter(s["table"], _pure).alias("alone"),
        ))).otherwise(state)

    empty = F.array().cast("array<bigint>")
    start = F.struct(sketch.alias("table"), empty.alias("left"), empty.alias("right"), F.filter(sketch, _pure).alias("alone"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.struct(
        (~F.exists(s["table"], lambda c: (c["n"] != 0) | (c["key"] != 0))).alias("whole"), s["left"].alias("left"), s["right"].alias("right"),
    ))


def job(kind: str, left: Column, right: Column, cells: int, groups: Column | None = None) -> Column:
    """One pair of digest lists as an entry of the list that ``differences`` takes."""
    if groups is None:
        groups = F.greatest(F.lit(1), F.ceil((F.size(left) + F.size(right)) / GROUP_DIGESTS))
    return F.struct(F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"), groups.cast("int").alias("groups"), F.lit(cells).alias("cells"))


def differences(rows: DataFrame, jobs: list[Column], keep_digests: bool = True) -> tuple[DataFrame, DataFrame]:
    """What pairs of digest lists differ in, and the sketches of kind ``print`` as text.

    ``rows`` has a unique ``_row`` and what the jobs read.  The first table is
    ``_row, kind, left, right``, the digests that only one side has, or their
    numbers; the second is ``_row, kind, text`` of jobs whose kind begins with
    ``print``, which are not peeled.
    """
    nothing = F.lit(None).cast("array<int>")
    # More parts than the shuffle has, so that the cells of a part are summed without a spill; a given number is not merged.
    parts = RANGES_A_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "_row").select("_row", F.explode(F.array(*jobs)).alias("_j")).select("_row", "_j.*", nothing.alias("only"))
    again = rows.select("_row", F.explode(F.filter(F.array(*jobs), lambda j: ~j["kind"].startswith("print"))).alias("_j")).select("_row", "_j.*")
    solved = None
    while True:
        made = sketches(dealt)
        printed = F.col("kind").startswith("print")
        result = F.when(~printed, peeled(F.col("sketch"), F.col("cells")))
        if not keep_digests:
            result = F.when(~printed, _bound(result, lambda p: F.struct(p["whole"].alias("whole"), F.size(p["left"]).alias("left"), F.size(p["right"]).alias("right"))))
        text = F.when(printed, written(F.col("sketch")))
        tried = cut_lineage(made.select("_row", "kind", "group", "cells", result.alias("_p"), text.alias("text")))
        if solved is None:
            prints = tried.where(printed).select("_row", "kind", "text")
        done = tried.where("_p.whole").select("_row", "kind", "_p.left", "_p.right")
        solved = done if solved is None else solved.unionByName(done)
        waiting = tried.where("not _p.whole").groupBy("_row", "kind").agg(F.collect_set("group").alias("only"), F.max("cells").alias("_had"))
        if waiting.isEmpty():
            break
        # Joined by row and kind, so the cells of a sketch still lie together.
        dealt = again.join(waiting, ["_row", "kind"]).withColumn("cells", 2 * F.col("_had") + 2).drop("_had")
    join = (lambda c: F.flatten(F.collect_list(c))) if keep_digests else F.sum
    return solved.groupBy("_row", "kind").agg(join("left").alias("left"), join("right").alias("right")), prints


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(column_or_null(docs, "doc_id", "bigint"), text.alias("text")).withColumn("_h", F.xxhash64("text"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, digests, next_text, next_digests``: each row beside the next lower id.

    The row with the lowest id is followed by that with the highest.  Rows
    without an id come last; rows of one id are ordered by a hash of their
    text.  The id is cut into ranges, each in order on its own; a range is
    given the last row of the one before it as a guest.
    """
    rows = _keyed(docs)
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(rows.select(F.percentile_approx("doc_id", shares, 10 * MOST_RANGES)).first()[0] or [])) if shares else []
    listed = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # Null ids are below all others.
    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(listed, lambda c: c < F.col("doc_id")))).alias("_range")
    ranged = rows.select("*", place)
    # One row per range, and there are at most so many ranges.
    lasts = sorted((r["_range"], r["o"]["doc_id"], r["o"]["_h"]) for r in ranged.groupBy("_range").agg(F.max(F.struct("doc_id", "_h")).alias("o")).collect())
    guests = spark.createDataFrame(
        [(lasts[k][0], *lasts[k - 1][1:]) for k in range(len(lasts))], "_to int, _id bigint, _hash bigint"
    )
    guest_rows = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    guest_rows = guest_rows.dropDuplicates(["_to"]).select("doc_id", "text", "_h", F.col("_to").alias("_range"), F.lit(0).alias("_own"))
    both = ranged.withColumn("_own", F.lit(1)).unionByName(guest_rows).withColumn("digests", digests(F.col("text")))
    order = Window.partitionBy("_range").orderBy("_own", F.col("doc_id").asc_nulls_first(), "_h")
    seen = both.withColumn("_next", F.lag(F.struct("text", "digests")).over(order)).where("_own = 1")
    return seen.select("doc_id", "text", "digests", F.col("_next.text").alias("next_text"), F.col("_next.digests").alias("next_digests"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, lost, gained`` for every row.

    The edited text has its second half replaced by the start of the next
    document.  A likeness is the share of the two texts' paragraphs that both
    have; two empty texts are alike.  ``lost`` and ``gained`` count the
    paragraphs that the edit took and brought.  A null text is the empty one.
    Of a single row, the next document is itself.
    """
    beside = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    table = beside.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "digests", "next_digests", edited.alias("edited"))
    table = table.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digests", digests(F.col("edited")).alias("edited_digests"), "next_digests"
    )
    fixed = cut_lineage(table).withColumn("_row", F.monotonically_increasing_id())
    own, changed, after, none = F.col("digests"), F.col("edited_digests"), F.col("next_digests"), F.array().cast("array<bigint>")
    apart, texts = differences(fixed.select("_row", "digests", "edited_digests", "next_digests"), [
        job("print own", own, none, BASE_CELLS, F.lit(1)), job("print edited", changed, none, BASE_CELLS, F.lit(1)),
        job("edited", own, changed, HALF_CELLS), job("next", own, after, FULL_CELLS),
    ], keep_digests=False)
    prints = texts.groupBy("_row").agg(*[F.max(F.when(F.col("kind") == f"print {k}", F.col("text"))).alias(k) for k in ("own", "edited")])
    apart = apart.select("_row", "kind", F.col("left").alias("lost"), F.col("right").alias("gained"))
    counts = apart.groupBy("_row").agg(*[
        F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("edited", "next") for c in ("lost", "gained")
    ])

    def likeness(kind: str) -> Column:
        shared = F.col("_n") - F.coalesce(f"{kind}_lost", F.lit(0))
        united = F.col("_n") + F.coalesce(f"{kind}_gained", F.lit(0))
        return F.when(united == 0, F.lit(1.0)).otherwise(shared / united).cast("double")

    blank = "0" * (28 * 3 * BASE_CELLS)
    sizes = fixed.select("_row", "doc_id", "n_chars", "edited_sha256", F.size("digests").alias("_n"))
    return sizes.join(prints, "_row", "left").join(counts, "_row", "left").select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("own", F.lit(blank)).alias("fingerprint"), F.coalesce("edited", F.lit(blank)).alias("edited_fingerprint"),
        likeness("edited").alias("near_edited"), likeness("next").alias("near_next"),
        F.coalesce("edited_lost", F.lit(0)).cast("bigint").alias("lost"), F.coalesce("edited_gained", F.lit(0)).cast("bigint").alias("gained"),
    )
