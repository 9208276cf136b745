"""Registration of queries and their SQL under the inventory's IDs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` as a query, checked by ``sql`` where that is given."""

    def register(plan: Callable[[fixtures.Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(fixtures.Tables(spark, sf_dir))
        if sql is not None:
            QUERIES[name].__doc__ = plan.__doc__
            own = sql.strip()
            ORACLE_SQL[name] = f"WITH {fixtures.SQL}, {own[5:]}" if own.upper().startswith("WITH ") else f"WITH {fixtures.SQL} {own}"
        return plan

    return register
