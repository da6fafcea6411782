"""Registering a query with its oracle beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, oracle


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, *fixtures: str, name: str | None = None):
        """Register f(tables) under its name; sql: the same in DuckDB, over fixtures."""

        def register(f: Callable[[Tables], DataFrame]):
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.oracles[key] = oracle(sql, *fixtures)
            return f

        return register
