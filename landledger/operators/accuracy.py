"""Accuracy of readings against known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.names import compare_names
from landledger.functions.ordered import with_position
from landledger.functions.orders import parse_mutation_type, parse_order_date
from landledger.functions.shares import normalised_share
from landledger.functions.text import folded, half_up, name_key, quoted, trim
from landledger.operators.corrections import learnable


def _scored(truth: DataFrame, reads: DataFrame, fields: list[str]) -> DataFrame:
    """One row per field with a truth: document_id, field, truth, got, score."""
    got = reads.selectExpr("document_id", *[f"{f} as got_{f}" for f in fields], "confidence as got_confidence")
    triples = ", ".join(f"{quoted(f)}, {f}, got_{f}, try_element_at(got_confidence, {quoted(f)})" for f in fields)
    return (
        truth.select("document_id", *fields).join(got, "document_id", "left")
        .selectExpr("document_id", f"stack({len(fields)}, {triples}) as (field, truth, got, score)")
        .filter("truth is not null")
    )


def _percent(part: str, whole: str) -> str:
    return f"if({whole} = 0, 0, int({half_up(f'{part} * 100.0D / {whole}')}))"


def extraction_accuracy(truth: DataFrame, reads: DataFrame) -> DataFrame:
    """Per field and over all (field null): populated, exact, wrong, wrong but flagged."""
    flagged = f"(coalesce(got, '') = '' or score is null or score < {fixed.LOW_CONFIDENCE}D)"
    return (
        _scored(truth, reads, fixed.RECORD_FIELDS)
        .rollup("field")
        .agg(
            F.count("*").alias("total"),
            F.expr("count_if(coalesce(got, '') <> '') as populated"),
            F.expr("count_if(got <=> truth) as exact"),
            F.expr("count_if(not (got <=> truth)) as wrong"),
            F.expr(f"count_if(not (got <=> truth) and {flagged}) as wrong_flagged"),
        )
        .selectExpr(
            "*", f"{_percent('populated', 'total')} as populated_pct", f"{_percent('exact', 'total')} as exact_pct",
            f"{_percent('wrong_flagged', 'wrong')} as wrong_flagged_pct",
        )
    )


def correction_memory_holdout(truth: DataFrame, reads: DataFrame) -> DataFrame:
    """Learn from the first half of the documents, measure exactness on the second.

    One row: documents and fields on each side, corrections taught, distinct entries,
    exact before and after, gains and regressions. The half is cut by document order.
    """
    scored = _scored(truth, reads, fixed.RECORD_FIELDS)
    documents = truth.select("document_id")
    blocks = documents.withColumn("one", F.lit(1))
    # Place in the whole order: counted per block of ids, so no single task sorts them all.
    placed = with_position(blocks, ["one"], ["document_id"], "document_id div 65536", "place").select("document_id", "place")
    halves = placed.join(documents.agg(F.count("*").alias("n"))).selectExpr(
        "document_id", "place", "place <= n div 2 as training"
    )
    split = scored.join(halves, "document_id")
    taught = (
        split.filter(f"training and not (got <=> truth) and got is not null and {learnable('got', 'truth')}")
        .withColumn("wrong_value", F.expr(folded("got")))
        .groupBy("field", "wrong_value")
        .agg(F.max_by("truth", "place").alias("fix"), F.count("*").alias("times"))
    )
    held = (
        split.filter("not training").withColumn("wrong_value", F.expr(folded("got")))
        .join(taught.select("field", "wrong_value", "fix"), ["field", "wrong_value"], "left")
        .withColumn("fixed", F.expr("if(got is null, got, coalesce(fix, got))"))
    )
    result = held.agg(
        F.count("*").alias("held_out_fields"),
        F.expr("count_if(got <=> truth) as before_exact"),
        F.expr("count_if(fixed <=> truth) as after_exact"),
        F.expr("count_if(not (got <=> truth) and fixed <=> truth) as gained"),
        F.expr("count_if(got <=> truth and not (fixed <=> truth)) as regressed"),
    )
    memory = taught.agg(
        F.expr("coalesce(sum(times), 0L)").alias("taught"), F.count("*").alias("distinct_entries")
    )
    sizes = halves.agg(F.expr("count_if(training) as train_documents"), F.expr("count_if(not training) as test_documents"))
    return (
        result.join(memory).join(sizes)
        .selectExpr(
            "*", f"{_percent('before_exact', 'held_out_fields')} as before_pct",
            f"{_percent('after_exact', 'held_out_fields')} as after_pct",
            "after_exact - before_exact as net_fields",
        )
    )


def classification_accuracy(kinds: DataFrame, truth: DataFrame) -> DataFrame:
    """Documents per true and recognised kind."""
    return (
        truth.select("document_id", "true_kind").join(kinds, "document_id")
        .groupBy("true_kind", "document_kind").agg(F.count("*").alias("documents"))
    )


def order_accuracy(truth: DataFrame, reads: DataFrame) -> DataFrame:
    """Per order field and over all: exact as printed, and usable (means the same thing)."""
    by_name = ", ".join(quoted(f) for f in ("from_owner", "to_owner", "village", "district"))
    usable = (
        "case when got is null then false "
        f"when field = 'mutation_type' then coalesce({parse_mutation_type('got')} = {parse_mutation_type('truth')}, false) "
        f"when field = 'order_date' then {parse_order_date('got')} <=> {parse_order_date('truth')} "
        f"when field = 'share' then coalesce({normalised_share('got')} = {normalised_share('truth')}, false) "
        f"when field in ({by_name}) then {compare_names(name_key('got'), name_key('truth'))}.verdict = 'same' "
        f"else {trim('got')} = {trim('truth')} end"
    )
    return (
        _scored(truth, reads, fixed.ORDER_FIELDS)
        .selectExpr("field", "got <=> truth as is_exact", f"{usable} as is_usable")
        .rollup("field")
        .agg(
            F.count("*").alias("total"), F.count_if("is_exact").alias("exact"), F.count_if("is_usable").alias("usable")
        )
        .selectExpr("*", f"{_percent('exact', 'total')} as exact_pct", f"{_percent('usable', 'total')} as usable_pct")
    )


def accuracy_by_mode(truth: DataFrame, reads: DataFrame) -> DataFrame:
    """Exact and populated fields per recognition mode; ``reads`` carries ``mode``."""
    got = reads.selectExpr("document_id", "mode", *[f"{f} as got_{f}" for f in fixed.RECORD_FIELDS])
    pairs = ", ".join(f"{f}, got_{f}" for f in fixed.RECORD_FIELDS)
    return (
        truth.select("document_id", *fixed.RECORD_FIELDS).join(got, "document_id")
        .selectExpr("mode", f"stack({len(fixed.RECORD_FIELDS)}, {pairs}) as (truth, got)")
        .filter("truth is not null")
        .groupBy("mode")
        .agg(
            F.count("*").alias("fields"), F.expr("count_if(got <=> truth) as exact"),
            F.expr("count_if(coalesce(got, '') <> '') as populated"),
        )
    )
