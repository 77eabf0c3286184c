"""Registers a query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registered(queries: dict, oracle: dict[str, str]) -> Callable[[str | None], Callable]:
    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query
