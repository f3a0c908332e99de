"""Registration of queries beside their oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.staging import small_batches


class Registry:
    """Queries of one module by name, and the DuckDB SQL of those that SQL can express.

    Queries hand whole texts to Python workers in small batches, so that a worker's memory does not grow with the table.
    """

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def keep(f):
            @functools.wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                small_batches(spark)
                return f(spark, sf_dir)

            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
