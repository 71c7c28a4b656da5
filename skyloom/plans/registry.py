"""All queries outside the llm subpackage, by name, with their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name."""

    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _sql[name]


def _load() -> None:
    from skyloom.plans import catalog_queries, evaluation_queries, lightcurve_queries, model_queries, reader_queries, sink_queries, vector_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
