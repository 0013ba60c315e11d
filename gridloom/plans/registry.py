"""The registry of queries: a name, the function that plans it, and its SQL in the oracle's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(views: str, sql: str | None, *ctes: str, name: str | None = None):
    """Register fn(view, ...) as a query: it gets the named adapters' frames in order."""

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*(getattr(adapters, v)(spark, sf_dir) for v in views.split()))

        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = adapters.sql_with(views, *ctes) + sql
        return fn

    return register
