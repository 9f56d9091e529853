"""Queries over the driver's tables, one per operator, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_queries, prompt_queries, search_queries  # noqa: F401
from ._base import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_queries.context_run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
