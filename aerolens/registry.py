"""All queries of the engine and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerolens.plans import analyst, flows, frames, logs  # noqa: F401  flows and logs add their queries to those of frames
from aerolens.plans.fixtures import sql_query, with_views

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: sql_query(sql) for name, sql in (analyst.QUERIES | analyst.SPARK_FORMS).items()} | frames.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, "duckdb") for name, sql in (analyst.QUERIES | frames.SQL).items()}
