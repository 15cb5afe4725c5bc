"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import the query modules and the pipeline; return the filled registries."""
    import corpus_pipeline
    from feedloom.llm import duplicate_queries, order_queries, record_queries, text_queries, vector_queries  # noqa: F401

    QUERIES["pipeline"] = corpus_pipeline.run

    return QUERIES, ORACLES
