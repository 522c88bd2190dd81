"""The register of queries: name, function of (spark, folder), and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("scans", "quality", "relations", "aggregates", "windows", "text", "graph", "forecast", "streams", "reports")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query. ``sql`` may start with WITH; the tables are views of the same names."""

    def register(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"{__package__}.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
