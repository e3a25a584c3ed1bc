"""Positioned words into the lines of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.ordered import union_all
from landledger.functions.text import BLANK, pattern
from landledger.session import settle

NEAR_DOWN, NEAR_ACROSS = 20, 40
# Words up to which a page's equal words are taken one at a time.
PAGE_LIMIT = 2048


def words_dedupe(words: DataFrame, page_limit: int = PAGE_LIMIT) -> DataFrame:
    """Keep the most confident of equal words read at the same spot.

    ``words`` has document_id, word_no, text, confidence, x, y, height. Of words of one text
    on one page the most confident is kept (the smaller word_no among equals), those less than 20 px
    down and 40 px across from it go, and so on. Words without a place take no part in this and are
    kept. A page of up to ``page_limit`` words travels once, its equal words together; those of longer
    pages are kept in rounds, spread over all tasks. Both ways keep the same words.
    """
    plain = words.selectExpr(
        "document_id", "text", "cast(word_no as bigint) as word_no", "cast(confidence as double) as confidence",
        "cast(x as double) as x", "cast(y as double) as y", "cast(height as double) as height",
    )
    long = settle(
        plain.groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") > page_limit)
        .select(F.col("document_id").alias("long_document"))
    )
    if long.isEmpty():
        return _taken_in_turn(plain)
    of_long = F.col("document_id").eqNullSafe(F.col("long_document"))
    short = _taken_in_turn(plain.join(long, of_long, "left_anti"))
    return short.unionByName(_kept_in_rounds(plain.join(long, of_long, "left_semi")))


def _taken_in_turn(words: DataFrame) -> DataFrame:
    """The words kept when equal words of a page are taken one at a time, best first."""
    near = f"coalesce(abs(o.x - w.x) < {NEAR_ACROSS} and abs(o.y - w.y) < {NEAR_DOWN}, false)"
    kept = f"aggregate(slice(met, 2, size(met)), slice(met, 1, 1), (acc, w) -> if(exists(acc, o -> {near}), acc, array_append(acc, w)))"
    return (
        words.groupBy("document_id", "text")
        .agg(F.expr("array_sort(collect_list(struct(-confidence as less, word_no, x, y, height))) as met"))
        .selectExpr("document_id", "text", f"inline(if(size(met) = 1, met, {kept}))")
        .selectExpr("document_id", "text", "word_no", "-less as confidence", "x", "y", "height")
    )


def _kept_in_rounds(plain: DataFrame) -> DataFrame:
    """The same for pages of any length.

    All words that no open rival outranks are kept at once: they are what taking one at a time
    would keep, for nothing that could have removed them is left. What lies near them goes, and the
    rest has its next round. Words without an equal on their page take no part in this.
    """
    columns = ["document_id", "text", "word_no", "confidence", "x", "y", "height"]
    # Words at the very same spot share the fate of the best of them, so only that one takes part.
    spots = plain.filter("x is not null and y is not null").groupBy("document_id", "text", "x", "y").agg(
        F.expr("min_by(struct(confidence, height, word_no), struct(-confidence, word_no)) as best")
    ).select("document_id", "text", "x", "y", "best.*")
    unplaced = plain.filter("x is null or y is null")
    several = spots.groupBy("document_id", "text").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("document_id").alias("of_document"), F.col("text").alias("of_text")
    )
    same = F.col("document_id").eqNullSafe(F.col("of_document")) & F.col("text").eqNullSafe(F.col("of_text"))
    spots, several = settle(spots), settle(several)
    alone = spots.join(several, same, "left_anti").select(columns).unionByName(unplaced.select(columns))
    cell = {"across": F.floor(F.col("x") / NEAR_ACROSS), "down": F.floor(F.col("y") / NEAR_DOWN), "id": F.monotonically_increasing_id()}
    open_ = settle(spots.join(several, same, "left_semi").withColumns(cell))
    rivals = settle(_rivals(open_))
    kept = []
    while True:
        # Those that a better one still stands against have to wait.
        waiting = rivals.select(F.col("worse").alias("id")).distinct()
        best = settle(open_.join(waiting, "id", "left_anti"))
        kept.append(best.select(columns))
        if rivals.isEmpty():
            break
        beaten = rivals.join(best.select(F.col("id").alias("better")), "better", "left_semi").select(F.col("worse").alias("id")).distinct()
        over = settle(best.select("id").unionByName(beaten))
        open_ = settle(open_.join(over, "id", "left_anti"))
        for side in ("better", "worse"):
            rivals = rivals.join(over.select(F.col("id").alias(side)), side, "left_anti")
        rivals = settle(rivals)
    return union_all([alone, *kept])


def _rivals(words: DataFrame) -> DataFrame:
    """better, worse: ids of equal words of a page that lie near each other.

    A word meets those of its own cell and the eight around it, so a page's words are compared
    with their neighbourhood alone.
    """
    around = F.expr("explode(array(-1L, 0L, 1L))")
    reach = words.withColumn("i", around).withColumn("j", around).selectExpr(
        "id as other", "document_id as of_document", "text as of_text", "confidence as of_confidence", "word_no as of_word",
        "x as of_x", "y as of_y", "across + i as across", "down + j as down",
    )
    near = (F.abs(F.col("x") - F.col("of_x")) < NEAR_ACROSS) & (F.abs(F.col("y") - F.col("of_y")) < NEAR_DOWN)
    same = (
        F.col("document_id").eqNullSafe(F.col("of_document")) & F.col("text").eqNullSafe(F.col("of_text"))
        & (words["across"] == reach["across"]) & (words["down"] == reach["down"])
    )
    return (
        words.join(reach, same).filter("id <> other").filter(near)
        .filter("struct(-confidence, word_no, id) < struct(-of_confidence, of_word, other)")
        .select(F.col("id").alias("better"), F.col("other").alias("worse"))
    )


def words_to_lines(words: DataFrame) -> DataFrame:
    """Group words into lines: document_id, line_no, text, confidence (0..1, of the worst word).

    A line breaks where the step down from the word before, in order of height on the
    page, exceeds 0.6 of the median word height (at least 12). Words of a line run left
    to right; an immediate repeat is dropped.
    """
    page = Window.partitionBy("document_id").orderBy("y", "word_no")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tolerance = "greatest(if(typical = 0, 20.0D, typical) * 0.6D, 12.0D)"
    # All three look at a page in one order, so that its words travel and are sorted once.
    cut = (
        words.filter("document_id is not null")
        .withColumn("typical", F.expr("percentile(height, 0.5D)").over(whole))
        .withColumn("step", F.col("y") - F.lag("y").over(page))
        .withColumn("breaks", F.expr(f"int(coalesce(step > {tolerance}, false))"))
        .withColumn("island", F.sum("breaks").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # Words of equal x keep the order they were met in, which is down the page.
    packed = "sort_array(collect_list(struct(x, y, word_no, text))).text"
    joined = "array_join(if(size(parts) = 1, parts, filter(parts, (p, i) -> i = 0 or p <> parts[i - 1])), ' ')"
    # Most lines hold single spaces alone and need not be written anew.
    odd = pattern(f"[{fixed.BLANKS.replace(' ', '')}]|  ")
    text = f"trim(if(joined rlike {odd}, regexp_replace(joined, {pattern(BLANK + '+')}, ' '), joined))"
    lines = (
        cut.groupBy("document_id", "island")
        .agg(F.expr(f"{packed} as parts"), F.expr("round(min(confidence) / 100.0D, 4) as confidence"))
        # Spread out of an array, a value is not worked out again in the filter on it.
        .selectExpr("document_id", "island", "confidence", f"explode(array({joined})) as joined")
        .selectExpr("document_id", "island", "confidence", f"explode(array({text})) as text")
        .filter("text <> ''")
    )
    numbered = Window.partitionBy("document_id").orderBy("island")
    return lines.select(
        "document_id", (F.row_number().over(numbered) - 1).alias("line_no"), "text", "confidence"
    )
