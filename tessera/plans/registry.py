"""A registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[Callable[[str | None], Callable[[Query], Query]], dict[str, Query], dict[str, str]]:
    """A decorator that registers a query under its function's name, with its
    SQL if there is one, and the two dictionaries it fills."""
    queries: dict[str, Query] = {}
    oracle_sql: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracle_sql[f.__name__] = sql
            return f

        return register

    return query, queries, oracle_sql
