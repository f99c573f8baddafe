"""All registered queries of the library and the SQL that states each result independently."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "q_A1_day_scalar_stats"

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query (spark, sf_dir) -> DataFrame, and SQL with the same columns and rows where SQL can express it."""

    def register(function: Callable) -> Callable:
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return register


def _load() -> None:
    from . import day, learners, relational, series, stats  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
