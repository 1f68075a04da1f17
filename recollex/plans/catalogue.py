"""The queries by name, and the SQL of each.  Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from recollex.plans import mining, prompts, retrieval, seeds, statements, structure, texts, timelines  # noqa: F401  (they fill the tables)

    return QUERIES, ORACLES
