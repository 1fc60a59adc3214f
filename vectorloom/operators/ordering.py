"""Order-dependent operators that never put all rows in one task.

Ranks, running totals, quantiles and lags over a whole table need a global
order.  A window without a partition key would send everything to one task, so
the order is cut into value ranges first: each range is sorted on its own and a
tiny table of per-range totals supplies what came before it.  The cut points
come from an approximate sketch; they decide only how even the ranges are,
never the result.  Repeated values are counted before the shuffle, so one hot
value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width


# A group of more rows is cut into slices; a smaller one is one task's work.
LARGE_GROUP = 1 << 17


def _sliced(df: DataFrame, group: Sequence[str], value: str, parts: int) -> DataFrame:
    """Adds ``_range``: which slice of its group's value order a row lies in."""
    shares = [k / parts for k in range(1, parts)]
    if list(group) == ["_all"]:
        # One group: the cut points are a short literal list, so nothing is joined.
        cuts = sorted(set(df.agg(F.percentile_approx(value, shares, max(1000, 20 * parts))).first()[0] or []))
        listed = F.array(*[F.lit(c) for c in cuts])
        return df.withColumn("_range", F.size(F.filter(listed, lambda c: c < F.col(value))) if cuts else F.lit(0))
    # Cut points of large groups alone, so they are few however many groups there are; a struct matches where a group is null.
    keyed = df.withColumn("_group", F.struct(*group))
    large = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > LARGE_GROUP).select("_group")
    marks = F.array(*[F.lit(s) for s in shares])
    cuts = keyed.join(F.broadcast(large), "_group").groupBy("_group").agg(F.percentile_approx(value, marks, F.lit(1000)).alias("_cuts"))
    joined = keyed.join(F.broadcast(cuts), "_group", "left")
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return joined.withColumn("_range", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)).drop("_cuts", "_group")


def running_totals(df: DataFrame, group: Sequence[str], value: str, amount: str, parts: int | None = None) -> DataFrame:
    """Adds ``before`` (sum of ``amount`` over smaller values) and ``total``.

    ``value`` must be unique within a group; aggregate repeats first.
    """
    parts = shuffle_width(df) if parts is None else parts
    if parts <= 1:
        whole = Window.partitionBy(*group)
        earlier = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", F.coalesce(F.sum(amount).over(earlier), F.lit(0)).alias("before"), F.sum(amount).over(whole).alias("total"))
    # A struct is never null, so rows whose group is null meet their totals too.
    ranged = _sliced(df, group, value, parts).withColumn("_place", F.struct(*group, "_range"))
    inside = Window.partitionBy("_place").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sliced = ranged.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    sums = ranged.groupBy("_place").agg(F.sum(amount).alias("_sum"))
    of = [F.col("_place")[name] for name in group]
    earlier = Window.partitionBy(*of).orderBy(F.col("_place")["_range"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_place",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy(*of)).alias("total"),
    )
    return (
        # Merged on the key that the window dealt by, so the rows are neither dealt again nor broadcast.
        sliced.join(offsets.hint("merge"), "_place")
        .withColumn("before", F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_range", "_place")
    )


def _keyed(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if group:
        return df, list(group)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def value_counts(df: DataFrame, group: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """Distinct values with their multiplicity and how many rows lie below."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("copies"))
    return running_totals(counted, group, value, "copies", parts)


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str], parts: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per share."""
    df, keys = _keyed(df.select(*group, value), group)
    counted = value_counts(df, keys, value, parts)

    def at(rank: Column) -> Column:
        hit = (F.col("before") <= rank) & (rank < F.col("before") + F.col("copies"))
        return F.max(F.when(hit, F.col(value)))

    aggregates = []
    for share, name in zip(shares, names):
        place = F.lit(float(share)) * (F.col("total") - 1)
        low = at(F.floor(place))
        high = at(F.ceil(place))
        part = F.max(place - F.floor(place))
        aggregates.append((low + (high - low) * part).alias(name))
    return counted.groupBy(*keys).agg(*aggregates).select(*group, *names)


SMALL_ROWS = 1 << 20
# A value is heavy from this share of a task's rows on: one in four.
HEAVY_SHARE = 4


def quantile_values(df: DataFrame, value: str, shares: Sequence[float], rows: int | None = None) -> list[float | None]:
    """The same for a whole column, fetched: one row.

    ``rows`` is a count the caller already has; a small one needs no ranges.
    """
    names = [f"q{k}" for k in range(len(shares))]
    parts = 1 if rows is not None and rows <= SMALL_ROWS else None
    rows = exact_quantiles(df, [], value, shares, names, parts).collect()
    return [rows[0][n] for n in names] if rows else [None] * len(shares)


def join_back(df: DataFrame, counted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Joins what was worked out per value to the rows that have it; ``counted`` has the rows' number as ``copies``.

    A value with more rows than a share of a task's is broadcast, so its rows
    stay where they are; there are fewer such values than that share allows,
    whatever the data.  Only the rest of the rows is shuffled.
    """
    parts = shuffle_width(df)
    if parts <= 1:
        return df.join(counted.drop("copies"), list(on))
    counted = cut_lineage(counted)
    total = counted.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * F.lit(HEAVY_SHARE * parts) > F.lit(total)
    heavy, light = (F.broadcast(counted.where(often).drop("copies")), counted.where(~often).drop("copies"))
    rest = df.join(F.broadcast(counted.where(often).select(*on)), list(on), "left_anti")
    return df.join(heavy, list(on)).unionByName(rest.join(light, list(on)))


def average_ranks(df: DataFrame, group: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """Adds 1-based ranks with ties averaged."""
    keyed, keys = _keyed(df, group)
    counted = value_counts(keyed.select(*keys, value), keys, value)
    ranks = counted.select(*keys, value, "copies", (F.col("before") + (F.col("copies") + 1) / 2.0).alias(rank))
    return join_back(keyed, ranks, [*keys, value]).drop("_all")


def positions(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Adds the 0-based place of each row in the order of a unique key."""
    keyed, keys = _keyed(df, [])
    spot = running_totals(keyed.select(*keys, key, F.lit(1).alias("_one")), keys, key, "_one")
    return df.join(spot.select(key, F.col("before").cast("bigint").alias(name)), key)


def _order_ranges(df: DataFrame, order: str) -> tuple[DataFrame, bool]:
    """Adds ``_range`` cut over the whole table's order key; says if there are several.

    Cuts are of the table, not of a group, so a group holding most rows still
    spreads over many tasks.
    """
    parts = shuffle_width(df)
    if parts <= 1:
        return df.withColumn("_range", F.lit(0)), False
    number = F.col(order).cast("double")
    shares = [k / parts for k in range(1, parts)]
    cuts = sorted(set(df.agg(F.percentile_approx(number, shares, max(1000, 20 * parts))).first()[0] or []))
    listed = F.array(*[F.lit(c) for c in cuts])
    # A key that is null is below all others, as in a sort.
    slot = F.when(number.isNull(), F.lit(0)).otherwise(F.size(F.filter(listed, lambda c: c < number))) if cuts else F.lit(0)
    return df.withColumn("_range", slot), bool(cuts)


def previous_rows(df: DataFrame, order: str, columns: Sequence[str], group: Sequence[str] = (), prefix: str = "prev_") -> DataFrame:
    """Adds each column's value in the preceding row of its group.

    ``order`` is unique within a group.  The last row of each (group, range)
    is handed to the next range.
    """
    keyed, keys = _keyed(df, group)
    keyed, several = _order_ranges(keyed, order)
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    packed = F.struct(*[F.col(c).alias(c) for c in columns])
    marked = keyed.withColumn("_lag", F.lag(packed).over(inside))
    if not several:
        return marked.select(*df.columns, *[F.col("_lag")[c].alias(prefix + c) for c in columns])
    lasts = keyed.groupBy(*keys, "_range").agg(F.max_by(packed, F.col(order)).alias("_last"))
    carried = lasts.select(*keys, "_range", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    source = F.coalesce("_lag", "_carry")
    return marked.join(carried, [*keys, "_range"], "left").select(*df.columns, *[source[c].alias(prefix + c) for c in columns])


def recent_values(df: DataFrame, order: str, value: str, depth: int, group: Sequence[str] = (), name: str = "recent") -> DataFrame:
    """Adds up to ``depth`` preceding values of the group, oldest first."""
    keyed, keys = _keyed(df, group)
    keyed, several = _order_ranges(keyed, order)
    by_range = Window.partitionBy(*keys, "_range")
    near = keyed.withColumn(name, F.collect_list(value).over(by_range.orderBy(order).rowsBetween(-depth, -1)))
    if several:
        tails = keyed.withColumn("_n", F.row_number().over(by_range.orderBy(F.desc(order)))).where(F.col("_n") <= depth)
        tails = tails.groupBy(*keys, "_range").agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_tail"))
        earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = tails.select(*keys, "_range", F.transform(F.flatten(F.collect_list("_tail").over(earlier)), lambda t: t[value]).alias("_carry"))
        both = F.concat("_carry", name)
        near = near.join(carried, [*keys, "_range"]).withColumn(name, F.slice(both, F.greatest(F.lit(1), F.size(both) - depth + 1), depth))
    return near.select(*df.columns, name)


def running_max(df: DataFrame, order: str, value: str, group: Sequence[str] = (), name: str = "highest") -> DataFrame:
    """Adds the largest value of the group's preceding rows."""
    keyed, keys = _keyed(df, group)
    parts = shuffle_width(df)
    if parts <= 1:
        inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return keyed.withColumn(name, F.max(value).over(inside)).select(*df.columns, name)
    # A struct is never null, so rows whose group is null meet what is carried to them too.
    ranged = _sliced(keyed.withColumn("_at", F.col(order).cast("double")), keys, "_at", parts).withColumn("_place", F.struct(*keys, "_range"))
    inside = Window.partitionBy("_place").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("_place").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*[F.col("_place")[k] for k in keys]).orderBy(F.col("_place")["_range"])
    carried = tops.select("_place", F.max("_top").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    near = ranged.withColumn(name, F.max(value).over(inside)).join(carried.hint("merge"), "_place")
    return near.withColumn(name, F.greatest(name, "_carry")).select(*df.columns, name)


def histogram(df: DataFrame, group: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts per group: ``bin``, ``lo``, ``hi``, ``n``.

    Last bin closed on the right, a constant column widened by half on each
    side, empty bins kept.
    """
    keyed, keys = _keyed(df.select(*group, value).where(F.col(value).isNotNull()), group)
    bounds = keyed.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    flat = F.col("_min") == F.col("_max")
    bounds = bounds.select(
        *keys,
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    )
    slot = F.least(F.width_bucket(F.col(value), F.col("_lo"), F.col("_hi"), F.lit(bins)), F.lit(bins)) - 1
    counts = keyed.join(F.broadcast(bounds), keys).withColumn("bin", slot.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return grid.join(counts, [*keys, "bin"], "left").select(
        *group,
        "bin",
        (F.col("_lo") + width * F.col("bin")).alias("lo"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
