"""Registry of the named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query function (spark, sf_dir) -> DataFrame with its SQL."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def queries() -> dict[str, Callable]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
