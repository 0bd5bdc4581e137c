"""The registered queries and, where SQL can say it, the text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(make: Query) -> Query:
        QUERIES[name] = make
        if sql is not None:
            ORACLE[name] = sql
        return make

    return register


def with_(*parts: str) -> str:
    """Common table expressions followed by the final select."""
    *tables, last = parts
    return "with " + ",\n".join(tables) + "\n" + last
