"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import route_queries, star_queries, text_queries  # noqa: F401  they register themselves
from skein.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Cases and value by district over the star join."""
    return QUERIES["j01_case_district"](spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
