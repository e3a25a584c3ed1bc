"""Writing results: keyed replacement, nested payloads, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landledger.functions.text import iso_millis, leading_number


def upsert_records(stored: DataFrame, arrivals: DataFrame, key: str = "document_id", version: str = "version") -> DataFrame:
    """Stored rows replaced by newer versions of the same key: the highest version stands.

    Stored rows of other keys stay as they are; only keys that occur in the arrivals are
    ranked. Of equal versions an arrival stands before a stored row.
    """
    keys = arrivals.select(key).distinct()
    touched = stored.join(keys, key, "left_semi").withColumn("_new", F.lit(0))
    both = touched.unionByName(arrivals.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    newest = both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")
    return stored.join(keys, key, "left_anti").unionByName(newest, allowMissingColumns=True)


def drop_other_kind(records: DataFrame, orders: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a page was read again: a khatauni keeps no order reading, and the other way round."""
    as_record = read.filter("document_kind = 'KHATAUNI'").select("document_id")
    as_order = read.filter("document_kind = 'MUTATION_ORDER'").select("document_id")
    return (
        records.join(as_order, "document_id", "left_anti"),
        orders.join(as_record, "document_id", "left_anti"),
    )


def registry_export(records: DataFrame, documents: DataFrame, approvals: DataFrame, actors: DataFrame, state: str = "Uttar Pradesh") -> DataFrame:
    """Nested payload per approved record as JSON: parcel, location, holder, provenance."""
    joined = (
        records.filter("status = 'VERIFIED' and ulpin is not null")
        .join(documents.select("document_id", "filename", F.col("created_at").alias("digitised_at")), "document_id")
        .join(approvals, "document_id", "left")
        .join(actors.selectExpr("actor_id as approved_by", "name as actor_name", "role as actor_role"), "approved_by", "left")
    )
    area = leading_number("plot_area")
    payload = (
        "named_struct('ulpin', ulpin, 'parcel', "
        "named_struct('khasraNumber', khasra_number, 'khataNumber', khata_number, 'surveyNumber', survey_number, "
        f"'area', if({area} is null, null, named_struct('value', {area}, 'unit', 'hectare')), "
        "'classification', land_classification), 'location', "
        f"named_struct('village', village, 'tehsil', tehsil, 'district', district, 'state', '{state}'), 'holder', "
        "named_struct('name', owner_name), 'provenance', named_struct('sourceDocument', filename, "
        f"'digitizedOn', {iso_millis('digitised_at')}, 'verifiedBy', "
        "if(actor_name is null, null, named_struct('name', actor_name, 'role', actor_role)), "
        f"'verifiedOn', {iso_millis('approved_at')}))"
    )
    return joined.selectExpr("document_id", "ulpin", f"to_json({payload}, map('ignoreNullFields', 'false')) as payload")


def write_by_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def accuracy_report_sink(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
