"""Registered queries and their DuckDB checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kpiloom.plans.tables import check_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, extra: dict[str, str] | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check_sql(check, extra)
        return function

    return add
