"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.world import SQL, World

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a World; sql is a SELECT over the tables and derived relations, or further ones that start with a comma."""

    def put(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, folder: f(World(spark, folder))
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {SQL.strip()}{'' if sql.lstrip().startswith(',') else ' '}{sql.strip()}"
        return f

    return put
