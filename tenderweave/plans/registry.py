"""A module's registry: query functions by name, and their SQL."""

from __future__ import annotations


def registry():
    """(queries, SQL by name, the decorator that adds to them)."""
    queries: dict = {}
    texts: dict = {}

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = f
            if sql:
                texts[name] = sql
            return f

        return add

    return queries, texts, query
