"""Registry of named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import oracle
from checks.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` may read the named oracle views."""
    def wrap(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle.statement(sql, views)
        return fn
    return wrap
