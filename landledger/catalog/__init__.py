"""Every operator as a runnable query over the driver's tables, with its check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types both engines print alike: whole numbers as bigint, days and times as text."""
    casts = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("integer", "short", "byte"):
            casts[field.name] = F.col(field.name).cast("bigint")
        elif kind == "date":
            casts[field.name] = F.col(field.name).cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            casts[field.name] = F.date_format(field.name, "yyyy-MM-dd HH:mm:ss.SSS")
    return df.withColumns(casts) if casts else df


def query(sql: str | None = None):
    """Register a query under its function's name, with its check where SQL can express it."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: plain(build(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load() -> None:
    from landledger.catalog import chains, figures, pages, records, scores  # noqa: F401
