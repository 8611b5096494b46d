"""A module's registered queries and their oracles."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None, name: str | None = None):
        """Register a function of session and dataset folder under its own name."""

        def keep(f):
            self.queries[name or f.__name__] = f
            if oracle:
                self.oracles[name or f.__name__] = oracle
            return f

        return keep
