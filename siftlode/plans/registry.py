"""Queries registered for the driver, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "topk_linear"


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with DuckDB SQL for the same rows if there is any."""

    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if oracle is not None:
            ORACLE[name] = oracle
        return query

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from . import click_queries, text_queries  # noqa: F401


load()
