"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import more, stored  # noqa: F401  register their queries
from quillspark.plans import queries as q


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and sparse ranks, fused: the ten best documents."""
    return q.rrf_two_way(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.SQL)
