"""Registration of checkable queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.session import prepare
from barloom.sources.views import Views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    """Register a function of :class:`Views` under ``name``, with the SQL that must give its rows."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Views(prepare(spark), folder))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
