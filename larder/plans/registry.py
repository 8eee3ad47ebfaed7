"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import plain_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); ``sql`` gives its rows by plain SQL, views in braces."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = plain_sql(sql)
        return f

    return keep
