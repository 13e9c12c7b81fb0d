"""How the modules of this package name their queries and oracles."""

from __future__ import annotations

from collections.abc import Callable


def register() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, oracles, decorator) of one module; the decorator takes the query's DuckDB SQL, where it has one."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(function):
            queries[function.__name__] = function
            if sql is not None:
                oracles[function.__name__] = sql
            return function

        return add

    return queries, oracles, query
