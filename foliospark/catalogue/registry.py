"""The table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str | None = None, oracle: str | None = None):
    """Register a query under its function's name, with SQL where SQL can express it."""

    def add(query: Callable[[SparkSession, str], DataFrame]):
        key = name or query.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = query
        if oracle is not None:
            ORACLES[key] = oracle
        return query

    return add
