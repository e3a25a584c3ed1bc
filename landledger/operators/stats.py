"""Dashboard figures: counts, means, trends, categories, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.text import half_up, mapped, quoted, trim


def document_wide(
    documents: DataFrame, records: DataFrame, orders: DataFrame | None = None, validation: DataFrame | None = None
) -> DataFrame:
    """Documents with their record, order and validation, one to one, where they exist.

    Columns of the right sides arrive as structs named record, reading and validation.
    """
    out = documents
    for name, right in (("record", records), ("reading", orders), ("validation", validation)):
        if right is not None:
            packed = F.struct(*[c for c in right.columns if c != "document_id"]).alias(name)
            out = out.join(right.select("document_id", packed), "document_id", "left")
    return out


def place_of_document(record: str = "record.district", reading: str = "reading.district") -> str:
    return f"coalesce({record}, {reading})"


def working_set(documents: DataFrame) -> DataFrame:
    """Everything an officer has not rejected."""
    return documents.filter("status <> 'REJECTED'")


def scoped(df: DataFrame, district: str | None) -> DataFrame:
    return df if district is None else df.filter(F.col("district") == district)


def status_counts(documents: DataFrame) -> DataFrame:
    """Documents per status, and whether the status counts as processed."""
    processed = ", ".join(quoted(s) for s in fixed.PROCESSED_STATUSES)
    return (
        documents.groupBy("status").agg(F.count("*").alias("documents"))
        .withColumn("is_processed", F.expr(f"status in ({processed})"))
    )


def district_counts(records: DataFrame) -> DataFrame:
    """Records per district, most first. Never narrowed to one district."""
    return (
        records.filter("district is not null").groupBy("district").agg(F.count("*").alias("records"))
        .orderBy(F.desc("records"), "district")
    )


def record_confidence() -> str:
    """Mean confidence of one record, 0 when nothing was read."""
    return (
        "if(coalesce(cardinality(confidence), 0) <= 0, 0.0D, "
        "aggregate(map_values(confidence), 0.0D, (a, b) -> a + b) / cardinality(confidence))"
    )


def mean_confidence(records: DataFrame) -> DataFrame:
    """Mean over every confidence value of every record; summed per row, never exploded."""
    return records.agg(
        F.expr("coalesce(sum(cardinality(confidence)), 0L) as readings"),
        F.expr(
            "if(coalesce(sum(cardinality(confidence)), 0) = 0, 0.0D, "
            "sum(aggregate(map_values(confidence), 0.0D, (a, b) -> a + b)) / sum(cardinality(confidence))) as mean_confidence"
        ),
    )


def quality_summary(records: DataFrame) -> DataFrame:
    """Rounded mean score of the scored records and how many are low. Rejected ones count."""
    return records.agg(
        F.count("quality_score").alias("scored"),
        F.expr(f"coalesce(int({half_up('avg(quality_score)')}), 0) as mean_quality"),
        F.expr(f"count_if(quality_score < {fixed.BAND_MEDIUM}) as low_quality"),
    )


def field_acceptance(documents: DataFrame, audit: DataFrame) -> DataFrame:
    """Fields of approved records that officers left as they were read."""
    edits = audit.filter("action = 'EDIT_FIELD'").groupBy("document_id").agg(F.count("*").alias("edits"))
    fields = len(fixed.RECORD_FIELDS)
    return (
        documents.filter("status = 'VERIFIED' and document_kind = 'KHATAUNI'").select("document_id")
        .join(edits, "document_id", "left")
        .agg(F.count("*").alias("records"), F.expr("coalesce(sum(edits), 0L)").alias("corrected"))
        .selectExpr(
            "records", f"records * {fields} as total", f"greatest(0L, records * {fields} - corrected) as accepted"
        )
    )


def validation_results(documents: DataFrame, validation: DataFrame) -> DataFrame:
    """Stored results without rejected documents, and documents not read yet."""
    joined = documents.select("document_id", "status").join(
        validation.select("document_id", "validation_status"), "document_id", "left"
    )
    counts = [
        f"count_if(status <> 'REJECTED' and validation_status = '{s}') as {s.lower()}"
        for s in ("PASS", "FLAGGED", "DUPLICATE")
    ]
    return joined.agg(*[F.expr(c) for c in [*counts, "count_if(status in ('UPLOADED', 'PROCESSING')) as not_read"]])


def issue_categories(issues: str = "issues") -> str:
    """Distinct categories of an array of findings; findings without a kind have none."""
    return (
        f"array_distinct(array_compact(transform({issues}, i -> {mapped('i.kind', fixed.CATEGORY_OF)})))"
    )


def category_list(spark) -> DataFrame:
    return spark.createDataFrame(
        [(c, n) for n, c in enumerate(fixed.ERROR_CATEGORIES)], "category string, place int"
    )


def error_categories(validated: DataFrame) -> DataFrame:
    """Records per category, each record once, worst category first, zeroes kept.

    Categories are made distinct on the row, so no distinct shuffle is needed.
    """
    counts = (
        validated.select(F.expr(f"explode({issue_categories()}) as category"))
        .groupBy("category").agg(F.count("*").alias("n"))
    )
    return (
        category_list(validated.sparkSession).join(counts, "category", "left")
        .selectExpr("category", "place", "coalesce(n, 0L) as records")
    )


def error_totals_live(stored: DataFrame, risk: DataFrame) -> DataFrame:
    """Stored categories plus the live conflicts and chain defects of the district table."""
    live = risk.agg(
        F.expr("coalesce(sum(reconciliation_conflicts), 0L) as conflicts"),
        F.expr("coalesce(sum(chain_defects), 0L) as defects"),
    )
    return stored.join(F.broadcast(live)).selectExpr(
        "category", "place",
        "records + case category when 'otherSystems' then conflicts when 'chain' then defects else 0L end as records",
    )


def state_of(district: str, states: dict[str, str] | None = None) -> str:
    """State of a district, exact after trimming; null when unknown."""
    known = states or {d: fixed.STATE_CODE for d in fixed.DISTRICT_HQ}
    return mapped(trim(district), known)


def state_progress(placed: DataFrame, states: dict[str, str] | None = None) -> DataFrame:
    """Per state: documents, verified, awaiting, districts; unassigned last.

    ``placed`` has status and district (of the record, or else of the order).
    """
    by_district = (
        placed.filter("district <> ''").groupBy("district").agg(
            F.count("*").alias("documents"),
            F.expr("count_if(status = 'VERIFIED') as verified"),
            F.expr("count_if(status in ('PENDING', 'FLAGGED')) as awaiting"),
        )
    )
    return (
        by_district.withColumn("state", F.expr(f"coalesce({state_of('district', states)}, 'UNASSIGNED')"))
        .groupBy("state").agg(
            F.sum("documents").alias("documents"), F.sum("verified").alias("verified"),
            F.sum("awaiting").alias("awaiting"), F.count("*").alias("districts"),
        )
        .orderBy(F.expr("state = 'UNASSIGNED'"), F.desc("documents"))
    )


def local_day(timestamp: str, zone: str) -> str:
    """Calendar day of a UTC timestamp in the office's zone."""
    return f"date(from_utc_timestamp({timestamp}, {quoted(zone)}))"


def daily_trend(documents: DataFrame, now: str, zone: str = "Asia/Kolkata", days: int = fixed.TREND_DAYS) -> DataFrame:
    """Documents per local day over the last days up to now, quiet days kept."""
    today = local_day(f"timestamp'{now}'", zone)
    calendar = documents.sparkSession.range(1).selectExpr(
        f"explode(sequence(date_sub({today}, {days - 1}), {today})) as day"
    )
    counts = (
        documents.filter(f"{local_day('created_at', zone)} between date_sub({today}, {days - 1}) and {today}")
        .groupBy(F.expr(local_day("created_at", zone)).alias("day")).agg(F.count("*").alias("n"))
    )
    return calendar.join(counts, "day", "left").selectExpr("day", "coalesce(n, 0L) as documents").orderBy("day")


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[
        F.expr(f"count_if(state = '{s}') as {s.lower()}") for s in ("QUEUED", "RUNNING", "FAILED", "DONE")
    ])


def job_outcomes(attempts: DataFrame) -> DataFrame:
    """Where each job stands, from the log of its attempts.

    ``attempts`` has job_id, document_id, attempt, succeeded, error. Done on success;
    queued again below three attempts, failed at three, which returns the document to
    UPLOADED.
    """
    return (
        attempts.groupBy("job_id")
        .agg(
            F.max("document_id").alias("document_id"), F.max("attempt").alias("attempts"),
            F.max_by(F.struct("succeeded", "error"), "attempt").alias("last"),
        )
        .selectExpr(
            "job_id", "document_id", "attempts",
            f"case when last.succeeded then 'DONE' when attempts >= {fixed.RETRY_LIMIT} then 'FAILED' else 'QUEUED' end as state",
            f"if(last.succeeded, null, substring(last.error, 1, {fixed.ERROR_TEXT_CHARS})) as error",
            f"if(not last.succeeded and attempts >= {fixed.RETRY_LIMIT}, 'UPLOADED', null) as document_status",
        )
    )
