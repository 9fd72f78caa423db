"""A decorator that registers a query with its oracle."""

from __future__ import annotations

from collections.abc import Callable


class Plans:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable) -> Callable:
            if name in self.QUERIES:
                raise ValueError(f"{name} is registered twice")
            self.QUERIES[name] = f
            if sql:
                self.ORACLE[name] = sql
            return f

        return add
