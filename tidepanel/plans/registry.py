"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.functions.numeric import stable
from tidepanel.plans.oracle_base import final

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, spec: str | None = None) -> Callable[[Query], Query]:
    """Register a query; with ``sql`` and its column ``spec`` it also gets an SQL check."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: stable(build(spark, sf_dir))
        QUERIES[name].__doc__ = build.__doc__
        if sql is not None:
            ORACLES[name] = final(sql, spec)
        return build

    return register
