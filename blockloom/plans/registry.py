"""The queries of this library by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import decode_queries, rollup_queries, store_queries

MODULES = (decode_queries, store_queries, rollup_queries)


def queries() -> dict[str, Callable]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
