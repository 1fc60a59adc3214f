"""Steps, speeds and events along an ordered series of feature vectors.

Lags come from :func:`ordering.previous_rows`, running sums from
:func:`ordering.running_totals`, so one long series spreads over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import insufficient, invalid
from ..functions import vec
from ..params import choice, float_param
from .ordering import join_back, previous_rows, quantile_values, running_totals

EVENT_METHODS = ("mad", "zscore", "percentile")
EVENT_DETAIL_ROWS = 200


def steps(df: DataFrame, order: str = "i", timestep: float = 1.0, group: tuple[str, ...] = ()) -> DataFrame:
    """Adds step distance, time and speed; the first row of a series has zero."""
    moved = previous_rows(df, order, ["features", order], group, "prev_")
    step = F.when(F.col("prev_features").isNull(), F.lit(0.0)).otherwise(
        vec.euclidean(F.col("features"), F.col("prev_features")))
    gap = (F.col(order) - F.col(f"prev_{order}")).cast("double") * F.lit(float(timestep))
    return (
        moved.withColumn("time", F.col(order).cast("double") * F.lit(float(timestep)))
        .withColumn("step_distance", step)
        .withColumn("speed", F.when(gap > 0, F.col("step_distance") / gap).otherwise(F.lit(0.0)))
        .withColumn("first_row", F.col("prev_features").isNull())
        .drop("prev_features", f"prev_{order}")
    )


def reference_distance(df: DataFrame, order: str = "i", group: tuple[str, ...] = ()) -> DataFrame:
    """Adds the distance to the first row of the series."""
    if not group:
        first = df.agg(F.min_by("features", order)).first()[0]
        if first is None:
            raise insufficient(1, 0)
        return df.withColumn("reference_distance", vec.euclidean(F.col("features"), vec.literal(first)))
    firsts = df.groupBy(*group).agg(F.min_by("features", order).alias("_origin"))
    return df.join(firsts, list(group)).withColumn(
        "reference_distance", vec.euclidean(F.col("features"), F.col("_origin"))).drop("_origin")


def cumulative_distance(stepped: DataFrame, order: str = "i", group: tuple[str, ...] = ()) -> DataFrame:
    keyed = stepped if group else stepped.withColumn("_all", F.lit(0))
    keys = list(group) or ["_all"]
    run = running_totals(keyed, keys, order, "step_distance")
    return run.withColumn("cumulative_distance", F.col("before") + F.col("step_distance")).drop("before", "total", "_all")


@dataclass(frozen=True)
class Threshold:
    method: str
    sensitivity: float
    value: float
    median: float
    mad: float
    mean: float
    std: float
    warnings: tuple[str, ...] = ()


def event_threshold(stepped: DataFrame, params: dict | None = None) -> Threshold:
    """Where a step counts as an event; a vanishing MAD falls back to the mean."""
    params = params or {}
    method = choice(params, "event_method", "mad", EVENT_METHODS)
    k = float_param(params, "event_sensitivity", 1.0 if method == "percentile" else 3.0, 2.220446049250313e-16)
    real = stepped.where(~F.col("first_row")).select(F.col("step_distance").alias("s"))
    base = real.agg(F.count("s").alias("n"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std")).first()
    if not base["n"]:
        raise insufficient(2, 1)
    if method == "percentile" and k >= 50:
        raise invalid("event_sensitivity must be below 50 for percentile detection")
    shares = [0.5] + ([1.0 - k / 100.0] if method == "percentile" else [])
    found = quantile_values(real, "s", shares, base["n"])
    median = found[0]
    mad = quantile_values(real.select(F.abs(F.col("s") - F.lit(median)).alias("g")), "g", [0.5], base["n"])[0]
    sigma = 1.4826 * mad
    warnings: tuple[str, ...] = ()
    if method == "percentile":
        value = found[1]
    elif method == "mad" and sigma > 0:
        value = median + k * sigma
    else:
        value = base["mean"] + k * base["std"]
        if method == "mad":
            warnings = ("step distances have no spread around their median; used mean + k * standard deviation",)
    return Threshold(method, k, value, median, mad, base["mean"], base["std"], warnings)


def events(stepped: DataFrame, threshold: Threshold, order: str = "i") -> DataFrame:
    """Steps strictly above the threshold, with their share of all steps below."""
    real = stepped.where(~F.col("first_row"))
    total = real.count()
    # Place among all steps, equal steps in series order.
    ties = running_totals(
        real.groupBy("step_distance").agg(F.count(F.lit(1)).alias("copies")).withColumn("_all", F.lit(0)),
        ["_all"], "step_distance", "copies").select("step_distance", "copies", "before")
    hits = join_back(real.where(F.col("step_distance") > F.lit(threshold.value)), ties, ["step_distance"])
    hits = hits.withColumnRenamed("before", "smaller").withColumn("_one", F.lit(1))
    # Equal steps rank in series order, still cut into ranges of the order key.
    hits = running_totals(hits, ["step_distance"], order, "_one")
    return hits.select(
        order, "step_distance",
        F.when(F.lit(threshold.value) > 0, F.col("step_distance") / F.lit(threshold.value)).alias("threshold_ratio"),
        ((F.col("smaller") + F.col("before") + 1) / F.lit(float(total))).alias("percentile"),
    )


def event_details(found: DataFrame, order: str = "i") -> DataFrame:
    """The first rows for display; the full set is :func:`events`."""
    return found.orderBy(order).limit(EVENT_DETAIL_ROWS)


def display_window(df: DataFrame, start: int, end: int, step: int, order: str = "i") -> DataFrame:
    """Frames to draw.  Statistics are always of the whole series."""
    if step < 1 or end < start:
        raise invalid("frame window must have end >= start and step >= 1")
    at = F.col(order)
    return df.where((at >= start) & (at <= end) & ((at - start) % step == 0))


def decimated(df: DataFrame, limit: int = 4000, order: str = "i") -> DataFrame:
    """A drawing of at most ``limit`` evenly strided points plus the last."""
    spot = running_totals(df.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1)), ["_all"], order, "_one")
    stride = F.greatest(F.lit(1), F.ceil(F.col("total") / limit))
    keep = (F.col("before") % stride == 0) | (F.col("before") == F.col("total") - 1)
    return spot.where(keep).drop("before", "total", "_all", "_one")


def trajectory(df: DataFrame, params: dict | None = None, order: str = "i") -> dict:
    """The whole analysis: a lazy table and the fitted threshold."""
    params = params or {}
    stepped = steps(df, order, float_param(params, "timestep", 1.0))
    table = cumulative_distance(reference_distance(stepped, order), order)
    threshold = event_threshold(stepped, params)
    return {"table": table, "threshold": threshold, "events": events(stepped, threshold, order)}

