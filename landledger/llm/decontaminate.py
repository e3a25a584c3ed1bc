"""Benchmark decontamination by winnowing: shared fingerprints, extended to exact spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.llm.shared import keyed, lowered, only_with, without
from landledger.session import settle

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 4


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and everything beyond ASCII, A-Z lower-cased."""
    return F.coalesce(F.array_remove(F.split(lowered(text), BREAKS), ""), F.array().cast("array<string>"))


def _beside(df: DataFrame, column: str, other: str, shift: int, join) -> DataFrame:
    """``column`` becomes join(column[i], other[i + shift]) for every i that has both."""
    n = F.greatest(F.size(other) - shift, F.lit(0))
    return df.withColumn(column, F.zip_with(F.slice(column, F.lit(1), n), F.slice(other, F.lit(shift + 1), n), join))


def grams(df: DataFrame, n: int) -> DataFrame:
    """Add ``gram``: the hash of the n words from each place on. Reads ``hashes``, one per word."""
    df = df.withColumn("gram", F.col("hashes"))
    for i in range(1, n):
        df = _beside(df, "gram", "hashes", i, lambda a, b: F.xxhash64(a, b))
    return df


def winnowed(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add ``least``: the minimum of each window - gram + 1 successive grams.

    Two texts that share ``window`` words share all grams in between, so also their minimum.
    """
    df = grams(df, gram).withColumn("least", F.col("gram"))
    reach, width = 1, window - gram + 1
    while reach < width:
        step = min(reach, width - reach)
        df = _beside(df, "least", "least", step, lambda a, b: F.least(a, b))
        reach += step
    return df


def _hashed(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def benchmark_hits(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """doc_id, row, n_words, n_hit, items (sorted list of text) for every row of ``docs``.

    A window is ``window`` successive words of an item; an item of fewer words is one window.
    A word inside any occurrence of a window is hit; items are those with a window that
    occurs. Fingerprints only find where to look; words decide. Items without item_id hit
    like others and are not named.

    Null or empty text has no words and no hits. Items without words occur nowhere. Repeated
    rows are judged one by one, repeated item_ids named once. Other columns are ignored.
    Empty tables: no rows, or no hits.
    """
    rows = keyed(docs, doc_id, text)
    tests = settle(
        items.select(F.col(item_id).cast("string").alias("name"), words(F.col(item_text)).alias("words"))
        .filter("size(words) > 0").distinct()
        # A null name still hits; a letter before the others keeps it apart from all of them.
        .select(F.coalesce(F.concat(F.lit("n"), "name"), F.lit("")).alias("item"), "words")
    )
    long = tests.filter(F.size("words") >= window)
    prints = settle(
        winnowed(_hashed(long, ["item"]), window, gram).select(F.explode(F.array_distinct("least")).alias("print")).distinct()
    )
    split = rows.select("doc_id", "row", words(F.col("text")).alias("words"))
    found = (
        winnowed(_hashed(split.filter(F.size("words") >= window), ["doc_id", "row"]), window, gram)
        .select("doc_id", "row", F.explode(F.array_distinct("least")).alias("print"))
        .join(prints, "print").select("doc_id", "row")
    )
    # Items below a window have no guaranteed minimum: all grams of their length are looked up.
    short = tests.filter(F.size("words") < window)
    lengths = [r[0] for r in short.select(F.size("words")).distinct().collect()]  # fewer than ``window``
    for n in sorted(lengths):
        whole = grams(_hashed(short.filter(F.size("words") == n), ["item"]), n).select(F.explode("gram").alias("print")).distinct()
        found = found.unionByName(
            grams(_hashed(split.filter(F.size("words") >= n), ["doc_id", "row"]), n)
            .select("doc_id", "row", F.explode(F.array_distinct("gram")).alias("print"))
            .join(whole, "print").select("doc_id", "row")
        )
    suspects = settle(found.distinct())

    # Where a gram of a suspect equals one of an item, the two are laid side by side.
    of_id, of_row = F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")
    again = settle(
        only_with(rows, suspects, ["doc_id", "row"]).distinct().select("doc_id", "row", words(F.col("text")).alias("words"))
    )
    offsets = None
    for n in sorted({min(gram, n) for n in lengths} | {gram}):
        some = tests.filter(F.size("words") == n) if n < gram else tests.filter(F.size("words") >= gram)
        item_grams = grams(_hashed(some, ["item"]), n).select("item", F.posexplode("gram").alias("at", "print"))
        if n == gram:
            item_grams = item_grams.join(_kept_prints(some, window, gram), ["item", "print"], "left_semi")
        doc_grams = grams(_hashed(again, ["doc_id", "row"]), n).select("doc_id", "row", F.posexplode("gram").alias("place", "print"))
        part = doc_grams.join(item_grams, "print").select("doc_id", "row", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
        offsets = part if offsets is None else offsets.unionByName(part)
    spans = (
        offsets.select(of_id, of_row, "item", "shift")
        .join(again, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")))
        .join(tests.withColumnRenamed("words", "item_words"), "item")
        .withColumn("start", F.greatest("shift", F.lit(0)))
        .withColumn("skip", F.col("start") - F.col("shift"))
        .withColumn("overlap", F.least(F.size("words") - F.col("start"), F.size("item_words") - F.col("skip")))
        .withColumn("need", F.least(F.size("item_words"), F.lit(window)))
        .filter("overlap >= need")
        .select(
            "doc_id", "row", "item", "start", "need",
            F.zip_with(
                F.slice("words", F.col("start") + 1, F.col("overlap")),
                F.slice("item_words", F.col("skip") + 1, F.col("overlap")), lambda a, b: a == b,
            ).alias("same"),
        )
        # The places at which ``need`` successive words are the same.
        .withColumn("from", F.filter(
            F.sequence(F.lit(1), F.size("same") - F.col("need") + 1),
            lambda i: ~F.array_contains(F.slice("same", i, F.col("need")), False),
        ))
        .filter("size(from) > 0")
        .select("doc_id", "row", "item", F.flatten(F.transform(
            "from", lambda i: F.sequence(F.col("start") + i - 1, F.col("start") + i + F.col("need") - 2)
        )).alias("places"))
    )
    hits = (
        spans.groupBy(of_id, of_row)
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.expr("nullif(substr(item, 2), '')"))).alias("items"))
    )
    counted = rows.select("doc_id", "row", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(
        hits, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), "left"
    ).select(
        "doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _kept_prints(tests: DataFrame, window: int, gram: int) -> DataFrame:
    """item, print: the winnowed prints of long items, all grams of short ones."""
    long, short = tests.filter(F.size("words") >= window), tests.filter(F.size("words") < window)
    return (
        winnowed(_hashed(long, ["item"]), window, gram).select("item", F.explode("least").alias("print"))
        .unionByName(grams(_hashed(short, ["item"]), gram).select("item", F.explode("gram").alias("print"))).distinct()
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without hits, with all their columns."""
    hit = settle(benchmark_hits(docs, items, doc_id, text, **options).filter("n_hit > 0").select("doc_id", "row").distinct())
    whole = docs.select(F.struct("*").alias("rest"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"))
    return without(whole, hit, ["doc_id", "row"]).select("rest.*")
