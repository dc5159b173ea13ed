"""Registry of the library's queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgrain.plans import data_queries, graph_queries, layout_queries, search_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


MODULES = (text_queries, search_queries, graph_queries, data_queries, layout_queries)


def queries() -> dict[str, Query]:
    """All queries by name."""
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Their SQL, where SQL can express them."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that the smoke check runs."""
    return search_queries.source_cap(spark, sf_dir)
