"""Registration of a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.views import Views, with_views

_BUILDERS: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(views)`` under ``name``; ``sql`` may use the views of ``views.SQL_VIEWS`` by name."""

    def register(build: Callable[[Views], DataFrame]):
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            _SQL[name] = with_views(sql)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Views(spark, sf_dir))

    return {name: bind(build) for name, build in _BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
