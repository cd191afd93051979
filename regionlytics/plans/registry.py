"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import interval_queries, model_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (interval_queries, table_queries, model_queries)


def queries() -> dict[str, Query]:
    return dict(interval_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(interval_queries.SQL)
