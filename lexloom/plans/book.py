"""A small register: query functions and, beside each, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Book:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE_SQL: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(f):
            self.QUERIES[name or f.__name__] = f
            if sql:
                self.ORACLE_SQL[name or f.__name__] = sql.strip()
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
