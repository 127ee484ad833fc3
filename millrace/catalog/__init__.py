"""Every operator as a query on the given tables, with its SQL counterpart.

A query is a function ``(spark, sf_dir) -> DataFrame``; its SQL, where the
operator can be said in SQL, gives the same columns and rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def load() -> None:
    from millrace.catalog import answering, evaluating, indexing, parsing, searching, streams  # noqa: F401
