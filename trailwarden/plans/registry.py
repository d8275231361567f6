"""All registered queries, gathered from the query modules."""

from __future__ import annotations

from . import case_queries, core_queries, model_queries, source_queries, table_queries

_MODULES = [core_queries, table_queries, case_queries, model_queries, source_queries]


def queries() -> dict:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
