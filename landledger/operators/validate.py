"""Validation of records: missing, implausible, unsure, duplicate, conflicting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.names import compare_names
from landledger.functions.ordered import with_rank
from landledger.functions.text import filled, half_up, leading_number, number_text, quoted
from landledger.operators.findings import FINDINGS, finding, gather
from landledger.operators.places import fuzzy_place_join, place_pairs, with_keys
from landledger.session import settle, stored

# Owner spellings per holding compared in the first round, and how much wider each next one is.
FIRST_LOOK, WIDER = 4, 8


def missing_fields() -> str:
    """Findings for required fields that are null or blank."""
    return gather(*[
        f"when not {filled(f)} then "
        + finding(quoted(f), "missing", "missing", {"field": quoted(f)}, {"field": quoted(fixed.RECORD_LABELS[f])})
        for f in fixed.REQUIRED_RECORD_FIELDS
    ])


def range_checks() -> str:
    """Findings for an implausible plot area and for digits in a name."""
    area = leading_number("plot_area")
    shown = {"area": number_text(area)}

    def of_area(code: str, params: dict | None = None) -> str:
        return finding("'plot_area'", "range", code, params)

    return gather(
        "when coalesce(plot_area, '') = '' then null "
        f"when {area} is null then {of_area('plotNotNumber', {'value': 'plot_area'})} "
        f"when {area} <= 0 then {of_area('plotZero')} "
        f"when {area} < {fixed.MIN_AREA_HA}D then {of_area('plotTooSmall', shown)} "
        f"when {area} > {fixed.MAX_AREA_HA} then {of_area('plotTooLarge', {**shown, 'max': str(fixed.MAX_AREA_HA)})}",
        f"when rlike(owner_name, '[0-9]') then {finding(quoted('owner_name'), 'range', 'ownerDigits')}",
    )


def confidence_checks(fields: list[str] = fixed.RECORD_FIELDS) -> str:
    """Findings for fields read with less than the wanted confidence, in field order."""
    score = "try_element_at(confidence, {f})".format
    return gather(*[
        f"when {score(f=quoted(f))} < {fixed.LOW_CONFIDENCE}D then "
        + finding(
            quoted(f), "confidence", "lowConfidence",
            {"field": quoted(f), "pct": half_up(f"{score(f=quoted(f))} * 100")},
        )
        for f in fields
    ])


def low_confidence_fields(fields: list[str] = fixed.RECORD_FIELDS) -> str:
    """Names of the fields read with less than the wanted confidence, in field order."""
    names = ", ".join(quoted(f) for f in fields)
    return f"filter(array({names}), f -> try_element_at(confidence, f) < {fixed.LOW_CONFIDENCE}D)"


def _two_smallest(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Per key: first and second smallest document id, each with its payload.

    Row numbers are limited to two, so Spark trims hot keys before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy("document_id")
    top = df.select(*keys, "document_id", *payload).withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    packed = F.struct("document_id", *payload)
    return top.groupBy(*keys).agg(
        F.min_by(packed, "rn").alias("first"),
        F.max(F.when(F.col("rn") == 2, packed)).alias("second"),
    )


# The group's first record, or its second where the first is the record itself.
_OTHER = "if(first.document_id <> document_id, first, second)"


def _keys_of(df: DataFrame, *more: str) -> DataFrame:
    """Ids and keys of records, with what the first of a group passes on."""
    if "ulpin" not in df.columns:
        df = df.withColumn("ulpin", F.lit(None).cast("string"))
    keyed = with_keys(df)
    wanted = ["document_id", "khasra_key", "khata_key", "village_key", "district_key", "owner_key", "owner_name", "ulpin"]
    return keyed.selectExpr(*[c for c in wanted if c in keyed.columns], *more)


def duplicate_parcels(
    records: DataFrame, verified: DataFrame | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """document_id -> first verified record of the same parcel, never itself.

    Columns: document_id, duplicate_of, duplicate_ulpin. Verified records are reduced to
    their two smallest ids per distinct parcel before anything is matched.
    """
    verified = records.filter("status = 'VERIFIED'") if verified is None else verified
    left = _keys_of(records.select("document_id", "khasra_number", "village", "district"))
    return _duplicates(left, _keys_of(verified), pairs)


def _duplicates(left: DataFrame, verified: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """:func:`duplicate_parcels` of rows that have their keys."""
    keys = ["khasra_key", "village_key", "district_key"]
    right = _two_smallest(verified.filter("khasra_key <> ''"), keys, ["ulpin"])
    return (
        fuzzy_place_join(left.select("document_id", *keys), right, "khasra_key", pairs)
        .selectExpr("document_id", f"{_OTHER} as other")
        .filter("other is not null")
        .groupBy("document_id")
        .agg(F.min("other").alias("other"))
        .selectExpr("document_id", "other.document_id as duplicate_of", "other.ulpin as duplicate_ulpin")
    )


def owner_conflicts(
    records: DataFrame,
    verified: DataFrame | None = None,
    pairs: DataFrame | None = None,
    first_look: int = FIRST_LOOK,
) -> DataFrame:
    """First verified record of the same holding whose owner is not the same person.

    Columns: document_id, conflict_with, conflict_owner, score, verdict, subset. Each
    holding is reduced to its distinct owner spellings; a record is compared with the
    earliest few of them, which nearly always settles it. Records that are still open go
    on to the next spellings, WIDER times as many from round to round, until they have met
    one that differs or all there are. The answer is exact.
    """
    verified = records.filter("status = 'VERIFIED'") if verified is None else verified
    left = _keys_of(records.select("document_id", "khata_number", "village", "district", "owner_name"))
    return _conflicts(left, _keys_of(verified), pairs, first_look)


def _conflicts(left: DataFrame, verified: DataFrame, pairs: DataFrame | None, first_look: int = FIRST_LOOK) -> DataFrame:
    """:func:`owner_conflicts` of rows that have their keys."""
    holding = ["khata_key", "village_key", "district_key"]
    left = left.select("document_id", *holding, F.col("owner_key").alias("my_key"))
    owners = verified.filter("owner_name <> '' and khata_key <> ''")
    spelled = _two_smallest(owners, [*holding, "owner_key"], ["owner_name"])
    if pairs is None:
        pairs = place_pairs(left, spelled)
    ranked = settle(with_rank(spelled, holding, [F.col("first.document_id")], "rank"))
    # A small table lies in one task, and with it the comparing of all records that are sent to it.
    cores = ranked.sparkSession.sparkContext.defaultParallelism
    if ranked.rdd.getNumPartitions() < cores:
        ranked = ranked.repartition(cores)

    def compared(mine: DataFrame, theirs: DataFrame) -> DataFrame:
        """Add ``hit`` where another record of the group names someone else."""
        return (
            fuzzy_place_join(mine, theirs, "khata_key", pairs)
            .selectExpr("*", f"{_OTHER} as other", f"{compare_names('my_key', 'owner_key')} as match")
            .withColumn(
                "hit",
                F.expr("if(match.verdict <> 'same' and other is not null, "
                       "struct(other.document_id, other.owner_name, match), null)"),
            )
        )

    # The last spelling of a round marks a holding that may have more; nothing after it comes
    # before it, so a hit up to there is the first.
    rounds, open_, done, reach = [], left, 0, first_look
    while True:
        met = settle(
            compared(open_, ranked.filter((F.col("rank") > done) & (F.col("rank") <= reach)))
            .groupBy("document_id", "my_key", *holding)
            .agg(F.min("hit").alias("hit"), F.expr(f"min(if(rank = {reach}, first.document_id, null)) as bound"))
        )
        rounds.append(met.filter("hit is not null").select("document_id", "hit"))
        open_ = met.filter("bound is not null and not coalesce(hit.document_id <= bound, false)").select(
            "document_id", "my_key", *holding
        )
        if open_.isEmpty():
            break
        done, reach = reach, reach * WIDER
    return (
        reduce(DataFrame.unionByName, rounds)
        .groupBy("document_id")
        .agg(F.min("hit").alias("hit"))
        .selectExpr(
            "document_id", "hit.document_id as conflict_with", "hit.owner_name as conflict_owner",
            "hit.match.score as score", "hit.match.verdict as verdict", "hit.match.subset as subset",
        )
    )


def _lead_finding() -> str:
    """The duplicate, or else the owner conflict, that goes first in the list."""
    parcel = {"khasra": "khasra_number", "village": "village", "ulpin": "duplicate_ulpin"}
    holding = {"khata": "khata_number", "owner": "conflict_owner", "pct": half_up("score * 100")}

    def duplicate(code: str) -> str:
        return finding("'khasra_number'", "duplicate", code, parcel)

    def owner(kind: str, code: str) -> str:
        return finding("'owner_name'", kind, code, holding)

    return gather(
        f"when duplicate_of is not null and duplicate_ulpin <> '' then {duplicate('duplicateUlpin')} "
        f"when duplicate_of is not null then {duplicate('duplicate')} "
        "when conflict_with is null then null "
        f"when verdict = 'different' then {owner('ownerConflict', 'ownerConflict')} "
        f"when subset then {owner('ownerVariant', 'ownerIncomplete')} "
        f"else {owner('ownerVariant', 'ownerVariant')}"
    )


def page_findings() -> str:
    """Everything that can be told from the page itself."""
    return f"concat({missing_fields()}, {range_checks()}, {confidence_checks()})"


def validate_records(
    records: DataFrame, verified: DataFrame | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """records + validation_status, issues (array), duplicate_of.

    A duplicate ends the check and goes first in the list; otherwise an owner conflict
    goes first. Checks on the page itself are expressions on the row.
    """
    # Keys are worked out once for all joins: their table is narrow, the work on names is not.
    if verified is None:
        mine = stored(_keys_of(records, "status = 'VERIFIED' as is_verified"))
        known = mine.filter("is_verified")
    else:
        mine, known = stored(_keys_of(records)), stored(_keys_of(verified))
    pairs = place_pairs(mine, known) if pairs is None else pairs
    duplicates = _duplicates(mine, known, pairs)
    conflicts = _conflicts(mine, known, pairs)
    status = (
        "case when duplicate_of is not null then 'DUPLICATE' when size(issues) > 0 then 'FLAGGED' else 'PASS' end"
    )
    return (
        records.join(duplicates, "document_id", "left")
        .join(conflicts, "document_id", "left")
        .withColumn("issues", F.expr(f"cast(concat({_lead_finding()}, {page_findings()}) as {FINDINGS})"))
        .withColumn("validation_status", F.expr(status))
        .drop("conflict_with", "conflict_owner", "score", "verdict", "subset", "duplicate_ulpin")
    )
