"""All queries over the given tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.plans import fixtures, graphs, records, relational

_ALL = relational.QUERIES | graphs.QUERIES | records.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: fixtures.sql(text, *views) if views else text for name, (_, text, views) in _ALL.items() if text}
