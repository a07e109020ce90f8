"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def register(name: str, run: Callable, sql: str | None = None) -> None:
    """Add a query (spark, sf_dir) -> DataFrame; a second one of that name is an error."""
    if name in _QUERIES:
        raise ValueError(f"query {name} is already registered")
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


#: Modules that register queries when imported.
MODULES = ("mesh_queries", "table_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
