"""What the document operators share: words, row batches, keys and lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

__all__ = ["binary_text", "column_or_null", "cut_lineage", "documents", "held_out", "map_rows", "prepare", "shielded", "unshielded", "whole_words"]

# A batch handed to Python holds at most so many bytes, whatever the rows' lengths.
BATCH_BYTES = "16m"


# Shuffle files go when the query that wrote them ends, not when the driver next collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Makes the package importable on executors, bounds the Arrow batches and frees the shuffles of steps done."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set(FREE_SHUFFLES, "true")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column_or_null(docs: DataFrame, name: str, kind: str) -> Column:
    """The column under that name, or null where the table has none."""
    return (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind).alias(name)


def shielded(docs: DataFrame, **added: Column) -> DataFrame:
    """The table's columns as ``c0, c1, ...`` beside added ones, so that no name can clash."""
    return docs.select(*[F.col(f"`{name}`").alias(f"c{k}") for k, name in enumerate(docs.columns)], *[column.alias(name) for name, column in added.items()])


def unshielded(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that ``shielded`` renamed, under their own names."""
    return rows.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)])


def binary_text(name: str = "text") -> Column:
    """Text as its UTF-8 bytes; a null stays null."""
    return F.col(name).cast("string").cast("binary").alias(name)


def whole_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes.

    ``bytes.split`` parts at just these six characters, and no byte of a longer
    UTF-8 sequence is one of them.
    """
    return text.split() if text else []


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` that leaves out empty batches, so that workers need not care."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(batch for batch in batches if batch.num_rows)

    return df.mapInArrow(filled, schema)
