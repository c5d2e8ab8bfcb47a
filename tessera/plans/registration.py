"""How a query joins the registry: its function, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function (spark, sf_dir) -> DataFrame by its name, with its DuckDB SQL if there is one."""

    def register(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register
