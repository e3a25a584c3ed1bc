"""Line dedup: hash normalised lines, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.llm.shared import join_on_hot, keyed, lowered
from landledger.session import settle

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCS = 5


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return lowered(F.btrim(line, F.lit(BLANKS)))


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """All columns of ``docs``, with the text less its repeated lines, and n_lines and n_dropped.

    A key of at least ``least_chars`` code points that at least ``least_docs`` documents
    hold loses all its lines, except in the largest doc_id that holds it. Keys are told
    apart by 128 bits of hash.

    Null or empty text is one empty line and comes out empty. Repeated rows of a doc_id count
    once and are treated alike; rows without doc_id are not counted and never the largest.
    Input columns called n_lines or n_dropped are replaced. No rows give no rows.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), F.struct(*[c for c in rest if c != text]).alias("rest"),
    )
    lines = settle(
        whole.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("place", "line"))
        .select("doc_id", "row", "place", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= least_chars)
        .select("doc_id", "row", "place", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))
    )
    held = lines.groupBy("h", "g").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("largest"), F.count("*").alias("n_rows")
    )
    repeated = settle(held.filter(F.col("n_docs") >= least_docs).select("h", "g", "largest", "n_rows"))
    dropped = (
        join_on_hot(lines, repeated, ["h", "g"], "n_rows").filter(~F.col("doc_id").eqNullSafe(F.col("largest")))
        .groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(F.collect_set("place").alias("places"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    joined = (
        whole.join(dropped, same, "left").select("text", "rest", "places")
        .withColumn("lines", F.split("text", "\n"))
        .withColumn("kept", F.when(F.col("places").isNotNull(), kept))
        .select(
            "rest",
            F.when(F.col("kept").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        )
    )
    return joined.select(
        *[F.col("kept_text").alias(text) if c == text else F.col("rest")[c].alias(c) for c in rest], "n_lines", "n_dropped"
    )
