"""A collection of queries, each with the SQL that another engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated query; without SQL its rows are held against tests only."""

        def put(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.oracles[name] = sql
            return query

        return put
