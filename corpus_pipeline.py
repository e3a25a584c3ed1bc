"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and all but
the last return the columns of documents. Between stages the rows are written as Parquet and
read again, so that a lost executor costs the work of one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.llm import language
from landledger.llm.decontaminate import drop_contaminated
from landledger.llm.line_dedup import drop_repeated_lines
from landledger.llm.near_dup import drop_near_duplicates
from landledger.llm.packing import packed_documents
from landledger.session import shared_folder, tune

#: Words of a shingle by which near-duplicates are told; the query op6_near_dedup has its own.
SHINGLE = 5
#: Calibrated score below which a language is not told for certain.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with a score of at least LEAST_SCORE.

    Learned from the documents that are not held out; texts without a letter and null texts go.
    Without any labelled document there is nothing to tell by, and none is left.
    """
    model = language.fit(docs.filter(~language.held_out()))
    told = language.predict(docs.drop("lang_pred", "score"), model)
    return told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars is counted anew."""
    kept = drop_repeated_lines(docs).drop("n_lines", "n_dropped")
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return kept.withColumn("n_chars", F.char_length("text").cast(kind)) if kind else kept


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return drop_near_duplicates(docs, shingle=SHINGLE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packed_documents(docs)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_near),
    ("benchmark", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the learned language nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    tune(spark)
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
