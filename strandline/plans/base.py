"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries of one module; ``register`` is used as a decorator on functions of (spark, sf_dir)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def register(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return put
