"""All queries of the package and, where SQL can state them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_MODULES = ("problems", "quality", "texts", "ranking", "measures", "workload", "lists", "vectors")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for m in _MODULES:
        import_module(f"tarazu.plans.{m}")


def queries() -> dict:
    _load()
    from tarazu.plans import problems

    return {**problems.QUERIES, **QUERIES}


def oracle_sql() -> dict:
    _load()
    from tarazu.plans import problems

    return {**problems.SQL, **SQL}
