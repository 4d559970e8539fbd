"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import views


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None, *needs: str):
        """Decorator: registers a query, and SQL that reads the views it needs."""

        def keep(f):
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = views.oracle(oracle, *needs)
            return f

        return keep
