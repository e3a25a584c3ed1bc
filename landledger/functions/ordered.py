"""Work in order within a key, without holding a key's rows together.

Two tools. The block functions split the order of a key into blocks, work inside each
block in parallel, and carry a small summary from block to block, so that one key with
a third of all rows is still spread over many tasks. ``scan_sorted`` is for state that
truly has to pass through every row: a sorted partition is streamed past a small
state, and memory does not grow with the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from landledger.session import settle, ship

BLOCK_ROWS = 4096


def _carry(df: DataFrame, keys: list[str], tail: Column, carried: Callable[[object], Column]) -> DataFrame:
    """Per key and block: what all earlier blocks of the key hand over."""
    before = Window.partitionBy(*keys).orderBy("_block")
    tails = df.groupBy(*keys, "_block").agg(tail.alias("_tail"))
    return tails.withColumn("_carry", carried(before)).drop("_tail")


def with_previous(df: DataFrame, keys: list[str], order: list[str], block: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the value of the row before, in order within the key."""
    df = df.withColumn("_block", F.expr(block))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    tail = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    carry = _carry(df, keys, tail, lambda w: F.lag("_tail").over(w))
    return (
        df.withColumn("_inside", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
        .join(carry, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_inside", "_carry")["v"])
        .drop("_block", "_inside", "_carry")
    )


def with_greatest_before(df: DataFrame, keys: list[str], order: list[str], block: str, value: Column, out: str) -> DataFrame:
    """Add ``out``: the greatest value among the rows before, in order within the key."""
    df = df.withColumns({"_block": F.expr(block), "_value": value})
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carry(
        df, keys, F.max("_value"),
        lambda w: F.max("_tail").over(w.rowsBetween(Window.unboundedPreceding, -1)),
    )
    return (
        df.withColumn("_inside", F.max("_value").over(inside))
        .join(carry, [*keys, "_block"], "left")
        .withColumn(out, F.expr("greatest(_inside, _carry)"))
        .drop("_block", "_value", "_inside", "_carry")
    )


def with_position(df: DataFrame, keys: list[str], order: list[str], block: str, out: str) -> DataFrame:
    """Add ``out``: the 1-based place of the row within its key.

    The block must rise with the order, for instance the day of a timestamp.
    """
    df = df.withColumn("_block", F.expr(block))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    carry = _carry(
        df, keys, F.count("*"),
        lambda w: F.sum("_tail").over(w.rowsBetween(Window.unboundedPreceding, -1)),
    )
    return (
        df.withColumn("_inside", F.row_number().over(inside))
        .join(carry, [*keys, "_block"], "left")
        .withColumn(out, F.expr("cast(_inside + coalesce(_carry, 0) as bigint)"))
        .drop("_block", "_inside", "_carry")
    )


def with_rank(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the 1-based place of the row within its key, for an order that has no natural blocks.

    Blocks are ranges of all rows by key and order, as even as Spark's sample makes them,
    so that a key with many rows lies in several.
    """
    cut = settle(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    return with_position(cut, keys, order, "_range", out).drop("_range")


def scan_sorted(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    start: Callable[[tuple], object],
    schema: str,
    chunk: int = 20000,
    only_with: Column | None = None,
) -> DataFrame:
    """Stream the rows of each key, sorted, past a state object.

    ``df`` must have the key columns first. ``start(key)`` makes the state of a key; its
    ``feed(row)`` and ``finish()`` yield output tuples. Rows arrive through Arrow in
    batches and are never gathered per key. With ``only_with``, keys without a row for which it
    holds are left out once the rows lie together, so that this takes no shuffle of its own.
    """
    ship(df.sparkSession)
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    width = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in arrow]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow
            )
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or row[:width] != key:
                    if state is not None:
                        out.extend(state.finish())
                    key = row[:width]
                    state = start(key)
                out.extend(state.feed(row))
                if len(out) >= chunk:
                    yield packed()
        if state is not None:
            out.extend(state.finish())
        if out:
            yield packed()

    dealt = df.repartition(*keys)
    if only_with is not None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        dealt = dealt.withColumn("_with", F.max(only_with).over(whole)).filter("_with").drop("_with")
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
