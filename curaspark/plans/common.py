"""What the query modules share: the register of queries, tables and SQL literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None):
    """Adds a query under its function's name, with its SQL unless SQL can't express it."""

    def add(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            SQL[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Generated answers with second deliveries, which differ in nothing that is kept here.

    Queries that make little of a text project first and take distinct rows of that, so texts aren't shuffled.
    """
    columns = ["task_id", "model", "persona_id", "group", "sentiment", "text", "is_refused", "refusal_reason", "finish_reason", "input_tokens", "output_tokens", "toxicity"]
    return table(spark, folder, "personas_merged_speech").select(*columns)


def speech(spark: SparkSession, folder: str) -> DataFrame:
    """Generated answers, each once."""
    return deliveries(spark, folder).distinct()


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
