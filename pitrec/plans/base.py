"""A register of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable) -> Callable:
            assert name not in self.queries, name
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
