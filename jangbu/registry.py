"""The registered queries of the core: every module that registers some is named here once."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("jangbu.tender", "jangbu.wording", "jangbu.contracts", "jangbu.evaluation", "jangbu.phrases", "jangbu.asking", "jangbu.grading", "jangbu.assets", "jangbu.checks", "jangbu.reading")


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL it is checked against where SQL can state it."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    for m in MODULES:
        import_module(m)
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
