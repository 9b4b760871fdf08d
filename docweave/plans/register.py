"""A query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql is not None:
                self.sql[name or f.__name__] = sql
            return f

        return keep
