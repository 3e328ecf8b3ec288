"""Registry of the queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator that files a query, and its SQL twin where there is one."""

    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from scanlake.plans import catalogue  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from scanlake.plans import catalogue  # noqa: F401

    return dict(_SQL)
