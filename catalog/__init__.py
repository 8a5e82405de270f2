"""Registered queries: each operator over the given tables, with equivalent SQL."""

from catalog import (  # noqa: F401
    aggregates,
    assimilation,
    dates,
    evaluation,
    filters,
    joins,
    models,
    reshaping,
    scalars,
    sources,
    windows,
)
from catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
