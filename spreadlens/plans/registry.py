"""Registry of named queries (Spark callables) and their SQL oracles."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sqlviews import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
ORACLE_EXTRA_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def sql_view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    """Register a derived SQL view usable by oracle queries."""
    ORACLE_EXTRA_VIEWS[name] = (deps, sql)


def query(key: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def oracle_sql() -> dict[str, str]:
    return {k: with_views(v, ORACLE_EXTRA_VIEWS) for k, v in ORACLE.items()}
