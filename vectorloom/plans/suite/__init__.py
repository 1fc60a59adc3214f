"""Every operator run over the shared tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ...session import ship_package
from . import checks, features, frames, records, spaces

PARTS = (features, spaces, frames, checks, records)
Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    """The query, after making sure executors can import the package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for part in PARTS:
        entries = getattr(part, attribute)
        clash = merged.keys() & entries.keys()
        if clash:
            raise ValueError(f"duplicate query names {sorted(clash)}")
        merged.update(entries)
    return merged


def queries() -> dict[str, Query]:
    return {name: _shipped(query) for name, query in _merged("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    found = _merged("SQL")
    unknown = found.keys() - _merged("QUERIES").keys()
    if unknown:
        raise ValueError(f"SQL without a query: {sorted(unknown)}")
    return found
