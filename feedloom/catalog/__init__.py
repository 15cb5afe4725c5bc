"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module and return the filled registries."""
    from feedloom.catalog import (  # noqa: F401
        classify_queries,
        cleaning_queries,
        cluster_queries,
        evaluation_queries,
        prioritize_queries,
        retrieval_queries,
        sampling_queries,
        table_queries,
    )

    return QUERIES, ORACLES
