"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, ops: str, sql: str | None = None) -> Callable:
    """Registers a query (spark, folder) -> DataFrame with the operators it covers and DuckDB SQL for the same rows."""

    def keep(f: Callable) -> Callable:
        QUERIES[name], COVERS[name] = f, tuple(ops.split())
        if sql:
            ORACLE[name] = sql
        return f

    return keep


from . import queries_events, queries_graph, queries_language, queries_objects, queries_relational, queries_storage, queries_vectors  # noqa: E402, F401
