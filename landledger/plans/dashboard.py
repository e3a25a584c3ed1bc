"""The figures of the dashboard, each one row or a short table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.operators import stats


def dashboard_stats(
    documents: DataFrame, records: DataFrame, validation: DataFrame, audit: DataFrame, now: str,
    district: str | None = None,
) -> dict[str, DataFrame]:
    """All dashboard figures by name. ``documents`` carries district, kind and created_at.

    A district narrows everything but the counts per district and per state.
    """
    scoped = stats.scoped(documents, district)
    narrowed = validation.join(scoped.select("document_id"), "document_id", "left_semi")
    working = narrowed.join(scoped.filter("status <> 'REJECTED'").select("document_id"), "document_id", "left_semi")
    return {
        "status_counts": stats.status_counts(scoped),
        "field_acceptance": stats.field_acceptance(scoped, audit),
        "validation_results": stats.validation_results(scoped, narrowed),
        "error_categories": stats.error_categories(working),
        "mean_confidence": stats.mean_confidence(stats.scoped(records, district)),
        "quality_summary": stats.quality_summary(stats.scoped(records, district)),
        "daily_trend": stats.daily_trend(scoped, now),
        "district_counts": stats.district_counts(records),
        "state_progress": stats.state_progress(documents),
    }


def dashboard_totals(documents: DataFrame, records: DataFrame, validation: DataFrame, audit: DataFrame, now: str, district: str | None = None) -> DataFrame:
    """The single figures side by side in one row."""
    parts = dashboard_stats(documents, records, validation, audit, now, district)
    totals = parts["status_counts"].agg(
        F.expr("coalesce(sum(if(is_processed, documents, 0)), 0L) as total_processed"),
        F.expr("coalesce(sum(if(status = 'PENDING', documents, 0)), 0L) as pending_verification"),
        F.expr("coalesce(sum(if(status = 'FLAGGED', documents, 0)), 0L) as flagged_documents"),
    )
    out = totals
    for name in ("field_acceptance", "validation_results", "mean_confidence", "quality_summary"):
        out = out.join(F.broadcast(parts[name]))
    return out
