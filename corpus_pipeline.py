"""Documents to packed sequences: quality, near-duplicates, secrets, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept.  Stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import mixing, packing, quality, resemblance, secrets
from vectorloom.llm.common import documents, prepare
from vectorloom.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def within_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality.kept_rows(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    SimHash and its covering masks make the first candidates, shared minima those that
    are beyond its bits; two documents are linked when at least 0.8 of their five-word
    shingles are shared.
    """
    prepare(spark)
    return resemblance.distinct_texts(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a label."""
    prepare(spark)
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", within_quality),
    ("simhash_near_dedup", without_copies),
    ("secret_scan", without_secrets),
    ("source_mix", mixed),
    ("best_fit_packing", packed),
]

# Quality rules, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet in the shared folder and read back."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
