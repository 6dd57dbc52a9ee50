"""The named queries over the reference's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from minuteworks.plans import queries_more, queries_python, queries_retrieval, queries_tables, queries_text

MODULES = (queries_text, queries_tables, queries_retrieval, queries_more, queries_python)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that SQL can answer."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
