"""Hash-chained audit trail: numbering, appending, verifying."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.functions.ordered import BLOCK_ROWS, scan_sorted, with_position, with_previous
from landledger.functions.text import iso_millis, let, pattern


# A text in quotes (with what is escaped in it), a number, or what stands between them.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'
# Only numbers with a point, an exponent or more digits than a double holds can be written otherwise.
_ODD_NUMBER = "[0-9][.eE]|[0-9]{16}|-0"


def canonical_number(number: str) -> str:
    """A JSON number as the shortest text of its double: plain from 1e-6 up to 1e21, else with a signed exponent."""
    shown = f"regexp_extract_all(cast(abs(try_cast({number} as double)) as string), '([0-9]+)|(-)', 0)"
    # The digits around the point, and the exponent where there is one: a - stands before a negative one.
    digits = let(
        shown, "p",
        "named_struct('all', concat(p[0], p[1]), 'point', length(p[0]) + case size(p) when 2 then 0 when 3 then int(p[2]) else -int(p[3]) end)",
    )
    bare = let(
        digits, "q",
        "named_struct('d', trim(both '0' from q.all), 'at', q.point - length(q.all) + length(ltrim('0', q.all)))",
    )
    small = "concat('0.', repeat('0', -b.at), b.d)"
    whole = "concat(b.d, repeat('0', b.at - length(b.d)))"
    split = "concat(substring(b.d, 1, b.at), '.', substring(b.d, b.at + 1))"
    power = "concat(left(b.d, 1), if(length(b.d) > 1, concat('.', substring(b.d, 2)), ''), 'e', if(b.at > 0, '+', '-'), abs(b.at - 1))"
    plain = (
        f"case when b.d = '' then '0' when b.at > 21 or b.at <= -6 then {power} when b.at <= 0 then {small} "
        f"when b.at >= length(b.d) then {whole} else {split} end"
    )
    return f"concat(if(try_cast({number} as double) < 0, '-', ''), {let(bare, 'b', plain)})"


def canonical_json(value: str) -> str:
    """A JSON text with its keys sorted, no spaces and every number in its one form; null when it is not JSON."""
    numbers = f"if(rlike(x, '^-?[0-9]'), {canonical_number('x')}, x)"
    tokens = f"transform(regexp_extract_all(c, {pattern(_TOKEN)}, 0), x -> {numbers})"
    return let(f"to_json(try_parse_json({value}))", "c", f"if(rlike(c, '{_ODD_NUMBER}'), array_join({tokens}, ''), c)")


def _json(value: str) -> str:
    """The canonical text; null when absent, and as a JSON string when not JSON."""
    return f"case when {value} is null then 'null' else coalesce({canonical_json(value)}, {_text(value)}) end"


def _text(value: str) -> str:
    """A plain value as a JSON string."""
    return f"substring(to_json(named_struct('v', cast({value} as string))), 6, length(to_json(named_struct('v', cast({value} as string)))) - 6)"


def envelope_head() -> str:
    """Canonical JSON of an entry up to the place of the previous hash."""
    return (
        f"concat('{{\"action\":', {_text('action')}, ',\"actorId\":', {_text('actor_id')}, ',\"after\":', {_json('after')}, "
        f"',\"before\":', {_json('before')}, ',\"documentId\":', {_text('document_id')}, ',\"prev\":')"
    )


def envelope_tail() -> str:
    return f"concat(',\"timestamp\":\"', {iso_millis('timestamp')}, '\"}}')"


def entry_hash(previous: str) -> str:
    """SHA-256 over the sorted, complete content of an entry and the hash before it."""
    link = f"if({previous} is null, 'null', concat('\"', {previous}, '\"'))"
    return f"sha2(concat({envelope_head()}, {link}, {envelope_tail()}), 256)"


def audit_numbering(entries: DataFrame) -> DataFrame:
    """Add ``seq``: 0-based place of an entry in its document, by time and then id."""
    numbered = with_position(entries, ["document_id"], ["timestamp", "entry_id"], "unix_date(date(timestamp))", "seq")
    return numbered.withColumn("seq", F.expr("seq - 1"))


class Trail:
    """Head of one document's chain while its new entries pass by in order."""

    def __init__(self, document_id):
        self.document_id = document_id
        self.seq: int | None = None
        self.head: str | None = None

    def feed(self, row: tuple):
        _, entry_id, content, tail, head_seq, head_hash, _ = row
        if self.seq is None:
            self.seq, self.head = (-1, None) if head_seq is None else (head_seq, head_hash)
        previous, self.seq = self.head, self.seq + 1
        link = "null" if previous is None else f'"{previous}"'
        self.head = hashlib.sha256(f"{content}{link}{tail}".encode()).hexdigest()
        yield (self.document_id, entry_id, self.seq, self.head, previous)

    def finish(self):
        return ()


def audit_append(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """entries + seq, hash and prev_hash, continuing each document's chain.

    ``entries`` has document_id, entry_id, actor_id, action, before, after, timestamp;
    ``heads`` has document_id, seq, hash of the last stored entry. The content of an
    entry is prepared by the engine; only the link from hash to hash is a sequential
    step, streamed in order with the head as its whole state.
    """
    prepared = entries.selectExpr(
        "document_id", "entry_id", f"{envelope_head()} as content", f"{envelope_tail()} as tail", "timestamp"
    )
    if heads is None:
        prepared = prepared.selectExpr("*", "cast(null as bigint) as head_seq", "cast(null as string) as head_hash")
    else:
        known = heads.selectExpr("document_id", "seq as head_seq", "hash as head_hash")
        prepared = prepared.join(known, "document_id", "left")
    links = scan_sorted(
        prepared.select("document_id", "entry_id", "content", "tail", "head_seq", "head_hash", "timestamp"),
        ["document_id"], ["timestamp", "entry_id"], lambda key: Trail(key[0]),
        "document_id bigint, entry_id bigint, seq bigint, hash string, prev_hash string",
    )
    return entries.join(links, ["document_id", "entry_id"])


def trail_heads(stored: DataFrame) -> DataFrame:
    """Last stored entry of every document."""
    return stored.groupBy("document_id").agg(F.max(F.struct("seq", "hash")).alias("h")).select("document_id", "h.*")


def audit_verify(stored: DataFrame) -> DataFrame:
    """First break of every document's chain: unhashed, unlinked or altered.

    Up to the first break the stored hashes equal the recomputed ones, so each row can
    be checked against its stored neighbour and no fold over the document is needed.
    Columns: document_id, entries, intact, broken_at, reason, head.
    """
    linked = with_previous(stored, ["document_id"], ["seq", "entry_id"], f"seq div {BLOCK_ROWS}", "hash", "expected")
    reason = (
        "case when hash is null then 'unhashed' when not (prev_hash <=> expected) then 'unlinked' "
        f"when {entry_hash('expected')} <> hash then 'altered' end"
    )
    checked = linked.selectExpr("document_id", "seq", "hash", "expected", f"{reason} as reason")
    return (
        checked.groupBy("document_id")
        .agg(
            F.count("*").alias("entries"),
            F.expr("min(if(reason is not null, struct(seq, reason, expected as head), null)) as broken"),
            F.expr("max_by(hash, seq) as last"),
        )
        .selectExpr(
            "document_id", "entries", "broken is null as intact", "broken.seq as broken_at",
            "broken.reason as reason", "if(broken is null, last, broken.head) as head",
        )
    )


def latest_approval(audit: DataFrame) -> DataFrame:
    """Last APPROVE entry of every document, with its actor."""
    return (
        audit.filter("action = 'APPROVE'").groupBy("document_id")
        .agg(F.max(F.struct("timestamp", "actor_id")).alias("a"))
        .selectExpr("document_id", "a.timestamp as approved_at", "a.actor_id as approved_by")
    )


def record_check(references: DataFrame, records: DataFrame, audit: DataFrame) -> DataFrame:
    """What the public may know about a reference: its state, approval and an intact trail.

    Columns: reference, result (found / badFormat / notFound), status, approved_at, intact,
    entries. Nothing personal is returned.
    """
    from landledger.operators.decisions import has_reference_form

    asked = references.selectExpr("reference", f"{has_reference_form('reference')} as well_formed")
    known = (
        asked.filter("well_formed").select("reference").distinct()
        .join(records.select(F.col("ulpin").alias("reference"), "document_id", "status"), "reference")
    )
    trail = audit.join(known.select("document_id").distinct(), "document_id", "left_semi")
    facts = (
        known.join(latest_approval(trail), "document_id", "left")
        .join(audit_verify(trail), "document_id", "left")
        .select("reference", "status", "approved_at", "intact", "entries")
    )
    return asked.join(facts, "reference", "left").selectExpr(
        "reference",
        "case when not well_formed then 'badFormat' when status is null then 'notFound' else 'found' end as result",
        "status", "approved_at",
        "if(status is null, null, coalesce(intact, true)) as intact",
        "if(status is null, null, coalesce(entries, 0L)) as entries",
    )
