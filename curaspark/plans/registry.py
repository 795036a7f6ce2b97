"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curaspark.plans import common, table_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(common.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(common.SQL)
