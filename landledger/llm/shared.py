"""Helpers of several operators: documents as keyed rows, joins on hot keys, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.session import settle, shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys with more than one row in this many are joined apart; there are fewer of them than this.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: str | Column) -> Column:
    """The text with A-Z lower-cased and every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and a hash of the text, under fixed names; other columns are left out.

    The hash tells rows apart that repeat a doc_id with another text.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))


def join_on_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join where ``right`` has one row per key and the number of left rows as ``count``.

    Keys with more than a ``HOT_SHARE``-th of all rows are fewer than ``HOT_SHARE``, so they
    are broadcast and their left rows stay where they are; the rest is shuffled, and no key
    of it can fill a task. Both inputs should be stored, for they are read twice.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    return left.join(F.broadcast(right.filter(hot)), keys).unionByName(left.join(right.filter(~hot), keys))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes in ``edges`` (a, b).

    Rounds of two steps: every node points its larger neighbours at its smallest one, then
    its smaller ones. Each round is a shuffle of the remaining edges and about halves the
    longest path; a node's list of neighbours is never gathered, only its minimum.
    """
    both = edges.select("a", "b").filter("a <> b")
    pairs = settle(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large step: neighbours above the node go to the smallest of the node and its neighbours.
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            around.join(least, "a").filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
        )
        # Small step: the node and its lower neighbours go to the smallest of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        pairs = settle(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


#: Words of 64 bits in a sieve: 16 million bits in 4 MB, whatever the number of keys.
SIEVE_WORDS = 2**18


def _word(columns: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SIEVE_WORDS))


def _bit(columns: list[Column]) -> Column:
    return F.xxhash64(F.lit(1), *columns).bitwiseAND(63).cast("int")


def _sieved(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with sieve_hit: false where their key is surely not among ``keys``.

    The sieve is a bitmap of fixed size that is broadcast; it spares most other rows a
    shuffle while the keys are some millions, and lets more of them through beyond that.
    """
    own = [F.col(c) for c in columns]
    bits = keys.select(_word(own).alias("sieve_word"), F.expr("1L").alias("one"), _bit(own).alias("bit"))
    words = bits.groupBy("sieve_word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("sieve_bits"))
    hit = F.coalesce(F.expr("shiftrightunsigned(sieve_bits, sieve_bit)").bitwiseAND(1) == 1, F.lit(False))
    marked = rows.withColumns({"sieve_word": _word(own), "sieve_bit": _bit(own)}).join(F.broadcast(words), "sieve_word", "left")
    return marked.withColumn("sieve_hit", hit).drop("sieve_word", "sieve_bit", "sieve_bits")


def _match(columns: list[str]) -> tuple[list[Column], Column]:
    """The keys under other names, and the null-safe equality with them."""
    names = [F.col(c).alias(f"key_of_{c}") for c in columns]
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"key_of_{c}"))
    return names, same


def only_with(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose key is among ``keys`` (stored, distinct); only these and a few more are shuffled."""
    names, same = _match(columns)
    hits = _sieved(rows, keys, columns).filter("sieve_hit").drop("sieve_hit")
    return hits.join(keys.select(*names), same, "left_semi")


def without(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose key is not among ``keys`` (stored, distinct); most of them stay where they are."""
    names, same = _match(columns)
    marked = _sieved(rows, keys, columns)
    hits = marked.filter("sieve_hit").drop("sieve_hit")
    return marked.filter("not sieve_hit").drop("sieve_hit").unionByName(hits.join(keys.select(*names), same, "left_anti"))


def stored(df: DataFrame, **options) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: compact, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)
