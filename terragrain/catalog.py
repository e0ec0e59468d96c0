"""Registered queries and their SQL equivalents, by operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under a name, with DuckDB SQL for the same rows if there is one."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


from . import catalog_more, catalog_overlay, catalog_pixels, catalog_records, catalog_streams, catalog_vector, catalog_warp  # noqa: E402, F401
