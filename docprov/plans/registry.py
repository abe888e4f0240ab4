"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from docprov.sources.register import FIXTURE_SQL

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries.
_MODULES = ("docprov.plans.audit", "docprov.plans.attribution", "docprov.plans.scalars", "docprov.plans.rasters", "docprov.plans.suite", "docprov.plans.streams")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql goes behind the derived tables of FIXTURE_SQL, or stands alone if it starts
    with WITH. One that starts with RECURSIVE has a table that asks for itself."""

    def add(f):
        _QUERIES[name] = f
        if sql and sql.startswith("RECURSIVE"):
            _SQL[name] = FIXTURE_SQL.replace("WITH", "WITH RECURSIVE", 1) + sql.removeprefix("RECURSIVE")
        elif sql:
            _SQL[name] = sql if sql.lstrip().startswith("WITH") else FIXTURE_SQL + sql.lstrip().removeprefix("AND")
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(m)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["attribute_leaks"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
