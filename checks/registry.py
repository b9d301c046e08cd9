"""Registry of queries: name -> (Spark callable, reference SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CHECKS: dict[str, tuple[Query, str | None]] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are checked by the driver and tests cover it."""
    def add(fn: Query) -> Query:
        assert name not in CHECKS, name
        CHECKS[name] = (fn, sql)
        return fn
    return add
