"""How queries are registered: a function over Inputs, with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stacksift.plans.views import Inputs


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def put(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
            self.queries[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
            if sql is not None:
                self.oracle[name] = sql
            return f

        return put
