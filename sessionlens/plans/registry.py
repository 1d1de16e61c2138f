"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query; sql starts with further CTEs ('x AS (...)') or SELECT and may read the named views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            head = ctes(*views)
            if body[:6].upper() == "SELECT":
                full = f"WITH {head} {body}" if head else body
            else:
                full = f"WITH {'RECURSIVE ' if recursive else ''}{head + ', ' if head else ''}{body}"
            ORACLES[name] = full
        return f

    return add
