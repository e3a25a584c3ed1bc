"""Reconciliation of records against other registers of the same parcel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.names import compare_names
from landledger.functions.text import filled, half_up, leading_number, mapped, number_text, quoted, trim
from landledger.operators.findings import finding, gather, penalty_sum
from landledger.operators.places import fuzzy_place_join, with_keys
from landledger.session import stored

_VALUES = ["owner_name", "khata_number", "plot_area", "land_classification"]


def whole_years(as_of: str, now: str) -> str:
    """Whole years of 365.25 days between two timestamps."""
    return f"int(floor((unix_millis({now}) - unix_millis({as_of})) / 31557600000.0D))"


def area_drift(ours: str, theirs: str) -> str:
    """Relative difference of two areas read as leading numbers; null when not numeric."""
    a, b = leading_number(ours), leading_number(theirs)
    return (
        f"case when {a} is null or {b} is null then null "
        f"when greatest(abs({a}), abs({b})) = 0 then 0.0D "
        f"else abs({a} - {b}) / greatest(abs({a}), abs({b})) end"
    )


def area_compare(ours: str, theirs: str) -> str:
    """struct(same, detail): areas agree within two percent, or as texts when not numeric."""
    drift = area_drift(ours, theirs)
    percent = number_text(f"(floor({drift} * 1000D + 0.5D) / 10D)")
    return (
        f"named_struct('same', coalesce({drift} <= {fixed.AREA_TOLERANCE}D, {trim(ours)} = {trim(theirs)}), "
        f"'detail', case when {drift} is null or greatest(abs({leading_number(ours)}), "
        f"abs({leading_number(theirs)})) = 0 then '' else concat({percent}, '%') end)"
    )


def _agreement(field: str) -> str:
    """Outcome of one field against one source row."""
    ours, theirs = field, f"their_{field}"
    if field == "owner_name":
        by_value = "case match.verdict when 'same' then 'agrees' when 'different' then 'differs' else 'variant' end"
    elif field == "plot_area":
        by_value = f"if({area_compare(ours, theirs)}.same, 'agrees', 'differs')"
    else:
        by_value = f"if({trim(ours)} = {trim(theirs)}, 'agrees', 'differs')"
    return (
        f"case when not {filled(theirs)} then 'absent' when not {filled(ours)} then 'differs' else {by_value} end"
    )


def match_sources(
    records: DataFrame, sources: DataFrame, now: str, pairs: DataFrame | None = None
) -> DataFrame:
    """One row per record and matching source row, with the outcome of each field.

    Source rows that say the same about a parcel are folded into one with a count,
    ``copies``, before the join; every sum downstream is weighted by it.
    """
    folded = with_keys(
        sources.groupBy("source", "khasra_number", "village", "district", *_VALUES, "as_of").agg(
            F.count("*").alias("copies")
        )
    ).select(
        "khasra_trim", "village_key", "district_key", "source", "as_of", "copies",
        F.col("owner_key").alias("their_key"), *[F.col(v).alias(f"their_{v}") for v in _VALUES],
    )
    ours = with_keys(records.filter("village <> '' and district <> ''")).select(
        "document_id", "khasra_trim", "village_key", "district_key", "owner_key", *_VALUES
    )
    if pairs is None:
        # Both are read twice then, for their places and for the join.
        ours, folded = stored(ours), stored(folded)
    hit = fuzzy_place_join(ours, folded, "khasra_trim", pairs).withColumn(
        "match", F.expr(compare_names("owner_key", "their_key"))
    )
    return hit.withColumns({
        **{f"{f}_agreement": F.expr(_agreement(f)) for f in fixed.RECONCILED_FIELDS},
        "years": F.expr(whole_years("as_of", f"timestamp'{now}'")),
    })


def _count(outcomes: str) -> str:
    flags = " + ".join(f"int({f}_agreement in ({outcomes}))" for f in fixed.RECONCILED_FIELDS)
    return f"coalesce(sum(copies * ({flags})), 0)"


def reconcile_sources(
    records: DataFrame, sources: DataFrame, now: str, pairs: DataFrame | None = None
) -> DataFrame:
    """Per record: matched sources, counts per outcome, stale sources and a status.

    Records no source knows are kept with status NOT_FOUND.
    """
    matched = match_sources(records, sources, now, pairs)
    summary = matched.groupBy("document_id").agg(
        F.expr("sort_array(collect_set(source)) as matched"),
        F.expr(f"{_count(quoted('agrees'))} as agrees"),
        F.expr(f"{_count(quoted('differs'))} as differs"),
        F.expr(f"{_count(quoted('variant'))} as variants"),
        F.expr(f"{_count(quoted('absent'))} as absent"),
        F.expr(f"coalesce(sum(if(years >= {fixed.STALE_YEARS}, copies, 0)), 0) as stale"),
    )
    return (
        records.select("document_id").join(summary, "document_id", "left")
        .selectExpr(
            "document_id", "coalesce(matched, cast(array() as array<string>)) as matched",
            *[f"coalesce({c}, 0L) as {c}" for c in ["agrees", "differs", "variants", "absent", "stale"]],
            "case when matched is null then 'NOT_FOUND' "
            "when differs + variants + stale > 0 then 'CONFLICTS' else 'AGREES' end as reconciliation",
        )
    )


def stale_sources(
    records: DataFrame, sources: DataFrame, now: str, pairs: DataFrame | None = None
) -> DataFrame:
    """Record and source pairs where the source is three or more whole years old."""
    return (
        match_sources(records, sources, now, pairs)
        .filter(F.col("years") >= fixed.STALE_YEARS)
        .select("document_id", "source", "as_of", "years", "copies")
    )


def _source_findings() -> str:
    """Findings of one record against one source row: fields first, then staleness."""
    source = {"source": mapped("source", fixed.SOURCE_LABELS, "source")}

    def conflict(field: str, code: str, params: dict, shown: dict | None = None) -> str:
        return finding(quoted(field), "sourceConflict", code, {"source": "source", **params}, {**source, **(shown or {})})

    cases = []
    for f in fixed.RECONCILED_FIELDS:
        theirs = f"their_{f}"
        named, label = {"field": quoted(f)}, {"field": quoted(fixed.RECORD_LABELS[f])}
        missing = conflict(f, "reconMissingHere", {**named, "value": theirs}, label)
        if f == "owner_name":
            other = (
                f"when {f}_agreement = 'differs' then {conflict(f, 'reconOwnerDiffers', {'theirs': theirs})} "
                f"else {conflict(f, 'reconOwnerVariant', {'theirs': theirs})}"
            )
        elif f == "plot_area":
            detail = f"{area_compare(f, theirs)}.detail"
            area = {"ours": f, "theirs": theirs, "pct": detail}
            other = f"else {conflict(f, 'reconArea', area)}"
        else:
            other = f"else {conflict(f, 'reconFieldDiffers', {**named, 'theirs': theirs}, label)}"
        cases.append(
            f"when {f}_agreement in ('agrees', 'absent') then null when not {filled(f)} then {missing} {other}"
        )
    stale = finding("'owner_name'", "sourceStale", "reconStale", {"source": "source", "years": "years"}, source)
    cases.append(f"when years >= {fixed.STALE_YEARS} then {stale}")
    return gather(*cases)


def reconciliation_findings(
    records: DataFrame, sources: DataFrame, now: str, pairs: DataFrame | None = None
) -> DataFrame:
    """document_id, source, copies and the array of findings against that source row.

    The list comes out of a generator, for a filter that Spark may move below it works out
    the comparison of every pair, and the list itself, once more.
    """
    listed = F.explode_outer(F.array(F.expr(_source_findings()))).alias("issues")
    return match_sources(records, sources, now, pairs).select("document_id", "source", "copies", listed).filter("size(issues) > 0")


def reconciliation_penalty() -> str:
    """Points lost to one source row, weighted by its copies."""
    return f"copies * {penalty_sum()}"
