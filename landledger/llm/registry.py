"""Where the queries of this subpackage are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landledger.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its check where SQL can express it."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register
