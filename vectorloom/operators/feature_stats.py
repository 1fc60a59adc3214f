"""Per-feature statistics: moments, exact quantiles, robust spread, fences, status.

Rows are unpivoted to (feature, value) and everything is a grouped aggregate,
so partial aggregation leaves a handful of rows per partition and feature.
Tables of a row per feature are broadcast to the values, never the other way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions.vec import RELATIVE_TOLERANCE, finite, unpivot
from ..params import float_param, int_param
from .ordering import exact_quantiles, histogram, running_totals

# Fixed values.
SIGMA_PER_MAD = 1.4826
FENCE = 1.5
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)
SHARE_NAMES = ("p05", "p25", "median", "p75", "p95")
EPSILON = 2.220446049250313e-16


def long_values(df: DataFrame, *keep: str) -> DataFrame:
    """``f, x`` with non-finite values as null."""
    return unpivot(df, *keep).withColumn("x", finite(F.col("x")))


def moments(long: DataFrame) -> DataFrame:
    return long.groupBy("f").agg(
        F.count("x").alias("finite_count"),
        (F.count(F.lit(1)) - F.count("x")).alias("invalid_count"),
        F.avg("x").alias("mean"),
        F.var_pop("x").alias("variance"),
        F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )


def quantiles(long: DataFrame) -> DataFrame:
    return exact_quantiles(long, ["f"], "x", SHARES, SHARE_NAMES).withColumn("iqr", F.col("p75") - F.col("p25"))


def robust_spread(long: DataFrame, middle: DataFrame) -> DataFrame:
    """Median absolute deviation and its normal-consistent sigma."""
    gaps = long.join(F.broadcast(middle.select("f", "median")), "f").select("f", F.abs(F.col("x") - F.col("median")).alias("gap"))
    mad = exact_quantiles(gaps, ["f"], "gap", [0.5], ["mad"])
    return mad.withColumn("robust_sigma", F.lit(SIGMA_PER_MAD) * F.col("mad"))


def fences(long: DataFrame, middle: DataFrame) -> DataFrame:
    """Values outside 1.5 IQR and the extremes of those inside."""
    joined = long.where(F.col("x").isNotNull()).join(
        F.broadcast(middle.select("f", "p25", "p75", (F.col("p25") - FENCE * F.col("iqr")).alias("low"),
                                  (F.col("p75") + FENCE * F.col("iqr")).alias("high"))), "f")
    outside = (F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))
    return joined.groupBy("f").agg(
        F.coalesce(F.min(F.when(~outside, F.col("x"))), F.max("p25")).alias("whisker_min"),
        F.coalesce(F.max(F.when(~outside, F.col("x"))), F.max("p75")).alias("whisker_max"),
        F.count_if(outside).alias("outlier_count"),
    )


def status(table: DataFrame, near_zero: float = 1e-4, low: float = 1e-2, constant: float = 1e-12) -> DataFrame:
    """Adds ``relative_variance`` and ``status``.

    One row per feature comes in, so the window over all rows is tiny.
    """
    if low < near_zero:
        raise invalid("low_variance_relative_threshold must be >= near_zero_relative_threshold")
    everything = Window.partitionBy(F.lit(0))
    top = F.max(F.when(F.col("finite_count") >= 2, F.col("variance"))).over(everything)
    relative = F.when(top > 0, F.col("variance") / top).otherwise(F.lit(0.0))
    tight = (F.col("std") <= RELATIVE_TOLERANCE * F.greatest(F.abs("mean"), F.lit(1.0))) | (
        F.col("max") - F.col("min") <= constant)
    label = (
        F.when(F.col("finite_count") == 0, "invalid")
        .when(F.col("finite_count") == 1, "insufficient")
        .when(tight, "constant")
        .when(relative < near_zero, "near_zero")
        .when(relative < low, "low_variation")
        .otherwise("active")
    )
    return table.withColumn("_relative", relative).withColumn("status", label).withColumn(
        "relative_variance", F.when(F.col("status").isin("invalid", "insufficient"), F.lit(None)).otherwise(F.col("_relative"))
    ).drop("_relative")


def feature_variance(df: DataFrame, params: dict | None = None) -> DataFrame:
    """The whole record, one row per feature."""
    params = params or {}
    long = long_values(df)
    middle = quantiles(long)
    ratio = F.when(F.col("robust_sigma") > EPSILON, F.col("std") / F.col("robust_sigma"))
    joined = (
        moments(long).join(middle, "f", "left").join(robust_spread(long, middle), "f", "left")
        .join(fences(long, middle), "f", "left").withColumn("std_robust_ratio", ratio)
        .withColumn("outlier_count", F.coalesce("outlier_count", F.lit(0)))
    )
    return status(
        joined,
        float_param(params, "near_zero_relative_threshold", 1e-4, 0.0),
        float_param(params, "low_variance_relative_threshold", 1e-2, 0.0),
        float_param(params, "constant_tolerance", 1e-12, 0.0),
    )


def top_features(table: DataFrame, params: dict | None = None) -> DataFrame:
    k = int_param(params or {}, "top_k", 20, 1)
    return table.orderBy(F.desc("variance"), "f").limit(k)


def summary(table: DataFrame) -> DataFrame:
    """One row of counts and variance extremes."""
    spread = F.when(F.col("finite_count") >= 2, F.col("variance"))
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count")
              for s in ("near_zero", "constant", "insufficient", "low_variation", "active", "invalid")]
    return table.agg(
        F.max(spread).alias("max_variance"), F.min(spread).alias("min_variance"),
        F.median(spread).alias("median_variance"), *counts,
        F.sum("invalid_count").alias("invalid_value_count"),
        F.count_if(F.col("status").isin("active", "low_variation")).alias("effective_nonzero_dimensions"),
    )


def feature_histogram(df: DataFrame, bins: int = 32) -> DataFrame:
    """Equal-width counts; a column too narrow for the bins is one centre bucket."""
    if not 8 <= bins <= 128:
        raise invalid("histogram_bins must be between 8 and 128")
    long = long_values(df).where(F.col("x").isNotNull())
    span = long.groupBy("f").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    # The narrowest bin two doubles of this size can still tell apart.
    narrow = (F.col("b") > F.col("a")) & (
        (F.col("b") - F.col("a")) / bins <= F.greatest(F.abs("a"), F.abs("b")) * EPSILON)
    marked = long.join(F.broadcast(span.withColumn("narrow", narrow)), "f")
    usual = histogram(marked.where(~F.col("narrow")), ["f"], "x", bins)
    pad = F.greatest(F.abs("a"), F.abs("b")) * 1e-9
    width = (F.col("b") - F.col("a") + 2 * pad) / bins
    start = F.col("a") - pad
    centre = (
        marked.where("narrow").groupBy("f", "a", "b").agg(F.count(F.lit(1)).alias("total"))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .select("f", "bin", (start + width * F.col("bin")).alias("lo"), (start + width * (F.col("bin") + 1)).alias("hi"),
                F.when(F.col("bin") == bins // 2, F.col("total")).otherwise(F.lit(0)).cast("bigint").alias("n"))
    )
    return usual.unionByName(centre)


def _spread_pick(place: Column, count: Column, wanted: Column) -> Column:
    """Whether ``place`` is one of ``trunc(k*(count-1)/(wanted-1))``, k below wanted."""
    step = F.when(wanted > 1, (count - 1) / (wanted - 1))
    guess = F.ceil(place / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        k = guess + shift
        exact = F.when(k == wanted - 1, count - 1).otherwise(F.floor(k * step))
        hit = hit | ((k >= 0) & (k < wanted) & (exact == place))
    return F.when(wanted <= 0, F.lit(False)).when(wanted == 1, place == 0).when(wanted >= count, F.lit(True)).otherwise(hit)


def distribution_sample(df: DataFrame, params: dict | None = None) -> DataFrame:
    """Evenly spread values per feature in row order, outliers kept first.

    A sampling operator: ``distribution_sample_size`` is how many values of a
    feature are drawn, as many as the caller asks for.  Statistics take all.
    """
    params = params or {}
    capacity = min(df.count(), int_param(params, "distribution_sample_size", 20_000))
    long = long_values(df, "i").where(F.col("x").isNotNull())
    middle = quantiles(long)
    low, high = F.col("p25") - FENCE * F.col("iqr"), F.col("p75") + FENCE * F.col("iqr")
    marked = long.join(F.broadcast(middle.select("f", "p25", "p75", "iqr")), "f").select(
        "i", "f", "x", ((F.col("x") < low) | (F.col("x") > high)).cast("int").alias("outside"))
    marked = marked.withColumn("_one", F.lit(1))
    placed = running_totals(marked, ["f"], "i", "_one").withColumnsRenamed({"before": "place", "total": "n"})
    placed = running_totals(placed, ["f"], "i", "outside").withColumnsRenamed({"before": "out_place", "total": "n_out"})
    room = F.least(F.col("n"), F.lit(capacity))
    crowded = F.col("n_out") >= room
    chosen = F.when(crowded, (F.col("outside") == 1) & _spread_pick(F.col("out_place"), F.col("n_out"), room)).otherwise(
        (F.col("outside") == 1) | _spread_pick(F.col("place"), F.col("n"), room - F.col("n_out")))
    return placed.where(chosen).select("f", "i", "x", F.col("outside").alias("outlier"))


def density(df: DataFrame, points: int = 80, bins: int = 32) -> DataFrame:
    """Gaussian kernel density on a fixed grid, scaled to histogram counts.

    Equal values are counted first; every distinct value then meets the fixed
    number of grid points and is summed away in the same stage.
    """
    long = long_values(df).where(F.col("x").isNotNull())
    base = long.groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.stddev_pop("x").alias("s"))
    span = F.col("b") - F.col("a")
    base = base.where((F.col("n") >= 2) & (span > EPSILON)).withColumn(
        "h", F.greatest(F.lit(1.06) * F.col("s") * F.pow(F.col("n"), F.lit(-0.2)), span / 80, F.lit(EPSILON)))
    step = (span + 6 * F.col("h")) / (points - 1)
    base = base.withColumn("first", F.col("a") - 3 * F.col("h")).withColumn("step", step)
    counted = long.groupBy("f", "x").agg(F.count(F.lit(1)).alias("c"))
    spread = counted.join(F.broadcast(base), "f").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("first") + F.col("k") * F.col("step")
    z = (at - F.col("x")) / F.col("h")
    return (
        spread.groupBy("f", "k")
        .agg(F.sum(F.col("c") * F.exp(F.lit(-0.5) * z * z)).alias("mass"), F.first(at).alias("spot"),
             F.first("n").alias("n"), F.first("h").alias("h"), F.first(span).alias("span"))
        .select("f", "k", "spot", (F.col("mass") / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * 3.141592653589793)))
                                 * F.col("n") * (F.col("span") / bins)).alias("density"))
    )
