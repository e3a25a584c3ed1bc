"""Officer decisions on records, and scoring again what they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.text import quoted, trim
from landledger.operators.places import place_pairs, with_keys


def reference_id(key: str) -> str:
    """A 14 character parcel reference, the same for the same key: state code and 12 hex digits."""
    return f"concat('{fixed.STATE_CODE}', upper(substring(sha2(cast({key} as string), 256), 1, 12)))"


def has_reference_form(value: str) -> str:
    """Whether a text could be a reference of any state: 14 capitals and digits."""
    return f"coalesce(rlike({value}, '^[A-Z0-9]{{14}}$'), false)"


def is_reference(value: str) -> str:
    return f"coalesce(rlike({value}, '^{fixed.STATE_CODE}[0-9A-F]{{12}}$'), false)"


def field_edits(records: DataFrame, decisions: DataFrame, fields: list[str] = fixed.RECORD_FIELDS) -> DataFrame:
    """decisions + edits: array of (field, before, after) for the values that really change.

    ``decisions`` has document_id, action, actor_id, decided_at and edited_fields, a map
    of field to new text. Blank text clears a field.
    """
    edits = ", ".join(
        f"if(map_contains_key(edited_fields, {quoted(f)}), "
        f"named_struct('field', {quoted(f)}, 'before', {f}, 'after', "
        f"nullif({trim(f'coalesce(edited_fields[{quoted(f)}], {quoted(str())})')}, '')), null)"
        for f in fields
    )
    return records.join(decisions, "document_id").withColumn(
        "edits", F.expr(f"filter(array_compact(array({edits})), e -> not (e.before <=> e.after))")
    )


def field_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records as they stand after an officer's decision.

    Edited fields take the new value and full confidence; the status becomes VERIFIED or
    REJECTED; a reference is kept, or issued on approval. Keeps ``edits`` for the audit.
    """
    edited = field_edits(records, decisions)
    after = "get(filter(edits, e -> e.field = {0}), 0).after"
    values = {
        f: F.expr(f"if(exists(edits, e -> e.field = {quoted(f)}), {after.format(quoted(f))}, {f})")
        for f in fixed.RECORD_FIELDS
    }
    vouched = (
        "map_concat(map_filter(confidence, (k, v) -> not exists(edits, e -> e.field = k)), "
        "map_from_entries(transform(edits, e -> struct(e.field, 1.0D))))"
    )
    return (
        edited.withColumns({
            **values,
            "confidence": F.expr(vouched),
            "previous_status": F.col("status"),
            "status": F.expr("if(action = 'approve', 'VERIFIED', 'REJECTED')"),
            "ulpin": F.expr(f"if(action = 'approve', coalesce(ulpin, {reference_id('document_id')}), ulpin)"),
        })
        .drop("edited_fields")
    )


def audit_entries(decided: DataFrame, labels: dict[str, str] = fixed.RECORD_LABELS) -> DataFrame:
    """One EDIT_FIELD entry per change, then the decision itself, in order.

    ``decided`` is the result of :func:`field_decisions`. ``before`` and ``after`` are
    JSON; entry_no is the place within the decision.
    """
    label = "case e.field " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in labels.items()) + " end"

    def value(which: str) -> str:
        return (
            f"to_json(named_struct('field', {label}, 'value', e.{which}), map('ignoreNullFields', 'false'))"
        )

    edits = (
        f"transform(edits, e -> named_struct('action', 'EDIT_FIELD', 'before', {value('before')}, "
        f"'after', {value('after')}))"
    )
    verdict = (
        "array(named_struct('action', if(action = 'approve', 'APPROVE', 'REJECT'), "
        "'before', to_json(named_struct('status', previous_status)), 'after', "
        "if(action = 'approve', to_json(named_struct('fieldsCorrected', size(edits), 'status', status, 'ulpin', ulpin)), "
        "to_json(named_struct('fieldsCorrected', size(edits), 'status', status)))))"
    )
    return decided.selectExpr(
        "document_id", "actor_id", "decided_at as timestamp", f"posexplode(concat({edits}, {verdict})) as (entry_no, e)"
    ).selectExpr("document_id", "entry_no", "actor_id", "e.action as action", "e.before as before", "e.after as after", "timestamp")


def records_of_parcels(records: DataFrame, changed: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Records describing a parcel whose register changed; each once."""
    keys = ["khasra_trim", "village_key", "district_key"]
    left = with_keys(records.filter("village <> '' and district <> ''"))
    right = with_keys(changed.select("khasra_number", "village", "district")).select(*keys).distinct()
    pairs = place_pairs(left, right) if pairs is None else pairs
    reached = right.join(pairs, ["village_key", "district_key"]).select(
        "khasra_trim", F.col("other_village").alias("village_key"), F.col("other_district").alias("district_key")
    ).filter("khasra_trim <> ''").distinct()
    return left.join(reached, keys, "left_semi").select(*records.columns)
