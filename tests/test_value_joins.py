"""Values stay where they are when a table of a row per feature is joined to them."""

import contextlib

import pytest
from pyspark.sql import functions as F

from vectorloom.operators import feature_stats as fs
from vectorloom.operators import ordering

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@contextlib.contextmanager
def threshold(spark, size):
    had = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, size)
    try:
        yield
    finally:
        spark.conf.set(THRESHOLD, had)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rows(spark):
    return spark.range(400).select(F.col("id").alias("i"), F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("features"))


@pytest.mark.parametrize("spread", [fs.robust_spread, fs.fences])
def test_values_are_not_broadcast(spark, rows, spread):
    long = fs.long_values(rows)
    # One row per feature, which the optimizer takes for larger than the values.
    middle = fs.quantiles(long).crossJoin(rows.select(F.max("i").alias("_wide"))).drop("_wide")
    made = spread(long, middle)
    assert "BuildLeft" not in plan(made)
    assert made.count() == 2


def test_histogram_does_not_deal_values_by_feature(spark, rows):
    with threshold(spark, "-1"):
        made = ordering.histogram(fs.long_values(rows), ["f"], "x", 8)
        # Only the grid of bins meets the counts by a merge.
        assert plan(made).count("SortMergeJoin") == 1
        assert [r["n"] for r in made.where("f = 0").orderBy("bin").collect()] == [50] * 8


def test_ranges_are_not_broadcast(spark, rows):
    with threshold(spark, "1g"):
        made = ordering.running_totals(fs.long_values(rows).withColumn("one", F.lit(1)).where("f = 0"), ["f"], "x", "one", parts=4)
        assert "BroadcastHashJoin [f" not in plan(made).split("Window")[0]
        assert [r["before"] for r in made.orderBy("x").collect()] == list(range(400))
