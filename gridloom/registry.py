"""Every registered query of the raster operators, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import queries_features, queries_learning, queries_pixels, queries_tables

_PARTS = (queries_pixels, queries_tables, queries_features, queries_learning)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_features.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for part in _PARTS for name, q in part.SQL.items()}
