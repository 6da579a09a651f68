"""All queries of the library by name, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.graph import VIEWS_SQL, Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a function of a Graph as a query; sql is its oracle, over the graph's views. It may begin with WITH."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Graph(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql) if views else sql
        return f

    return add


def with_views(sql: str) -> str:
    text = sql.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {VIEWS_SQL},\n{text[5:]}"
    return f"WITH {VIEWS_SQL}\n{text}"

