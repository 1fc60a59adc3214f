"""The shared tables in the shapes operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.vec import feature_rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds every double column."""
    return df.select(*[rounded(F.col(n), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return feature_rows(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("label").cast("int").alias("label"))


def reference_side(df: DataFrame) -> DataFrame:
    """Half the groups; the other half is the query side."""
    return df.where(F.col("label") < 5)


def query_side(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") >= 5)


def half(df: DataFrame, side: str) -> DataFrame:
    """The first or second half of the coordinates: two aligned spaces."""
    start = 1 if side == "left" else 33
    return df.withColumn("features", F.slice("features", start, 32))


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as four features; a missing tax makes the fourth not a number."""
    lines = table(spark, sf, "lineitem")
    gap = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity") / F.col("l_tax"))
    return lines.select(F.array("l_quantity", F.col("l_extendedprice") / 1000, "l_discount", gap).alias("features"))


# --- the same in SQL ---------------------------------------------------------

RAW = "e AS (SELECT vec_id AS i, label, embedding::DOUBLE[] AS v FROM embeddings)"


def standardized(source: str, name: str, where: str = "TRUE", fit_where: str | None = None, values: str = "v") -> str:
    """CTEs that scale ``source`` by moments of the rows ``fit_where`` selects."""
    fit_where = where if fit_where is None else fit_where
    return f"""
 {name}_u AS (SELECT i, label, unnest({values}) AS x, unnest(range(0, len({values}))) AS f FROM {source}),
 {name}_m AS (SELECT f, avg(x) AS m, stddev_pop(x) AS s FROM {name}_u WHERE {fit_where} GROUP BY f),
 {name} AS (SELECT i, label, list((x - m) / s ORDER BY f) AS v FROM {name}_u JOIN {name}_m USING (f)
   WHERE {where} GROUP BY i, label)"""


ORDER_LINES = """lines AS (SELECT unnest([l_quantity, l_extendedprice / 1000, l_discount,
   CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE l_quantity / l_tax END]) AS x, unnest([0, 1, 2, 3]) AS f FROM lineitem),
 good AS (SELECT f, x FROM lines WHERE isfinite(x))"""


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"
