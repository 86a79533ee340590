"""Registration of queries with their SQL, and the loader they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under ``name``, which no other has."""

        def put(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return put

    def over(self, name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        """Register a query that maps one table."""
        self.add(name, sql)(lambda spark, sf_dir: build(table(spark, sf_dir, source)))
