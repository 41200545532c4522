"""Registry of named queries and their SQL oracles; each module of plans adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its oracle where SQL can express it."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from fathomline.plans import load_all

    load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from fathomline.plans import load_all

    load_all()
    return dict(_ORACLES)
