"""The registered queries and, where SQL can say it, their equivalent over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its DuckDB twin."""
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from plumbline.plans import (  # noqa: F401
        diff_queries, lineage_queries, outlier_queries, profile_queries, reply_queries, source_queries,
    )
    return dict(QUERIES), dict(ORACLES)
