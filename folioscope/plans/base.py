"""How a module registers its queries."""

from __future__ import annotations


def registry() -> tuple[dict, dict, object]:
    """(QUERIES, SQL, decorator): the decorator registers a function by its name, with its SQL where there is one."""
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return put

    return queries, sql, query
