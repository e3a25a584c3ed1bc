"""Lists people work from: queues, notices, pages, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.text import mapped, quoted, trim

NOTICE_LIMIT = 30
RECENT_LIMIT = 12
PAGE_DEFAULT, PAGE_MAX = 25, 100


def documents_list(documents: DataFrame, status: str | None = None, district: str | None = None) -> DataFrame:
    """Documents, newest first; an unknown status does not filter."""
    out = documents
    if status in fixed.STATUS_ORDINAL:
        out = out.filter(F.col("status") == status)
    if district:
        out = out.filter(F.col("district") == district)
    return out.select("document_id", "filename", "status", "district", "updated_at").orderBy(
        F.desc("updated_at"), "document_id"
    )


def review_queue(wide: DataFrame) -> DataFrame:
    """Documents awaiting a person, flagged ones first, then newest.

    ``wide`` has filename, status, updated_at and the structs record, reading and
    validation (with issues).
    """
    waiting = ", ".join(quoted(s) for s in fixed.REVIEWABLE_STATUSES)
    return (
        wide.filter(f"status in ({waiting})")
        .selectExpr(
            "document_id", "filename", "status", "coalesce(record.village, reading.village) as village",
            "coalesce(record.district, reading.district) as district", "updated_at",
            "coalesce(cardinality(validation.issues), 0) as issue_count",
            "try_element_at(validation.issues, 1).issue as top_issue",
        )
        .orderBy(F.expr(mapped("status", fixed.STATUS_ORDINAL)), F.desc("updated_at"), "document_id")
    )


def queue_search(queue: DataFrame, status: str = "ALL", district: str = "ALL", text: str = "") -> DataFrame:
    """Queue rows of a status and district whose file or place contains the text, case folded."""
    needle = text.strip().lower()
    out = queue
    if status != "ALL":
        out = out.filter(F.col("status") == status)
    if district != "ALL":
        out = out.filter(F.col("district") == district)
    if needle:
        hits = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in ("filename", "village", "district")]
        out = out.filter(hits[0] | hits[1] | hits[2])
    return out


def notices(wide: DataFrame, limit: int = NOTICE_LIMIT) -> DataFrame:
    """The newest documents that want attention: undecided orders and flagged records."""
    return (
        wide.filter(
            "(document_kind = 'MUTATION_ORDER' and status in ('PENDING', 'FLAGGED')) "
            "or (document_kind = 'KHATAUNI' and status = 'FLAGGED')"
        )
        .selectExpr(
            "document_id", "if(document_kind = 'MUTATION_ORDER', 'order', 'flagged') as notice", "filename",
            "if(record is not null, concat_ws(' · ', nullif(record.village, ''), nullif(record.district, '')), "
            "concat_ws(' · ', nullif(reading.village, ''), nullif(reading.district, ''))) as place",
            "try_element_at(validation.issues, 1).issue as finding", "updated_at",
        )
        .orderBy(F.desc("updated_at"), "document_id").limit(limit)
    )


def recent_activity(documents: DataFrame, district: str | None = None, limit: int = RECENT_LIMIT) -> DataFrame:
    out = documents if district is None else documents.filter(F.col("district") == district)
    return out.orderBy(F.desc("updated_at"), "document_id").limit(limit)


def records_page(
    records: DataFrame, cursor: int | None = None, limit: int = PAGE_DEFAULT, district: str | None = None
) -> DataFrame:
    """One page of approved records by id, with the cursor of the next page on each row."""
    size = min(PAGE_MAX, max(1, limit or PAGE_DEFAULT))
    out = records.filter("ulpin is not null and status = 'VERIFIED'")
    if district and district.strip():
        out = out.filter(F.col("district") == district.strip())
    if cursor is not None:
        out = out.filter(F.col("document_id") > cursor)
    # One row more than a page tells whether another page follows; it is a handful of rows.
    ahead = out.orderBy("document_id").limit(size + 1)
    page = ahead.orderBy("document_id").limit(size)
    end = ahead.agg(F.count("*").alias("n"))
    last = page.agg(F.max("document_id").alias("last"))
    return (
        page.join(F.broadcast(end)).join(F.broadcast(last))
        .withColumn("next_cursor", F.expr(f"if(n > {size}, last, null)")).drop("n", "last")
    )


def lookup_by_reference(references: DataFrame, records: DataFrame) -> DataFrame:
    """Approved records of a batch of references; references are trimmed and in capitals."""
    asked = references.select(F.upper(F.expr(trim("reference"))).alias("ulpin")).distinct()
    return records.filter("status = 'VERIFIED'").join(asked, "ulpin", "left_semi")


def duplicate_pointer(validated: DataFrame, documents: DataFrame) -> DataFrame:
    """File name and reference of the document a duplicate points at."""
    target = documents.selectExpr(
        "document_id as duplicate_of", "filename as duplicate_filename", "ulpin as duplicate_ulpin"
    )
    return (
        validated.filter("duplicate_of is not null").select("document_id", "duplicate_of")
        .join(target, "duplicate_of", "left")
    )
