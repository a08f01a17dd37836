"""All registered queries of the standings operators."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of (spark, folder) under its name, with its SQL twin if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _load() -> None:
    from podium.operators import queries  # noqa: F401  registers on import


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
