"""Pieces of check SQL shared by several queries (DuckDB dialect, ASCII names)."""

from __future__ import annotations

import re

from landledger import fixed
from landledger.plans.views import oracle_with

_HONORIFICS = ", ".join(f"'{w}'" for w in fixed.HONORIFICS if w.isascii())
FIELDS = list(enumerate(fixed.RECORD_FIELDS))


def said(template: str, **values: str) -> str:
    """A finding text as SQL: placeholders become expressions."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return "concat(" + ", ".join(
        values[p[1:-1]] if p[0] == "{" else "'" + p.replace("'", "''") + "'" for p in parts
    ) + ")"


def toks(x: str) -> str:
    spaced = f"regexp_replace(lower(coalesce({x}, '')), '[.,;:''\"()\\[\\]/\\\\-]', ' ', 'g')"
    return f"list_filter(string_split_regex({spaced}, '\\s+'), lambda t: t <> '' AND t NOT IN ({_HONORIFICS}))"


def place(x: str) -> str:
    return f"array_to_string({toks(x)}, ' ')"


def sim(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - "
        f"levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))::DOUBLE) END)"
    )


def compared(table: str, a: str, b: str) -> str:
    """SELECT over ``table`` adding score, verdict and subset of token lists a and b."""
    best = (
        "list_max(list_transform(range(len(g)), lambda i: {'score': CASE WHEN list_contains(acc.taken, i) "
        f"THEN -1.0::DOUBLE ELSE {sim('t', 'g[i+1]')} END, 'rank': -i}}))"
    )
    fold = (
        f"list_reduce(s, lambda acc, t: list_transform([{best}], lambda b: CASE WHEN b.score >= 0.8 THEN "
        "{'matched': acc.matched + b.score, 'taken': list_append(acc.taken, -b.rank)} ELSE acc END)[1], "
        "{'matched': 0.0::DOUBLE, 'taken': []::BIGINT[]})"
    )
    return f"""SELECT * EXCLUDE (s, g, st),
  CASE WHEN len(s) = 0 THEN 0.0::DOUBLE ELSE floor(st.matched / len(g) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE END AS score,
  CASE WHEN len(s) = 0 THEN 'different' WHEN st.matched / len(g) >= 0.92 THEN 'same'
       WHEN st.matched / len(g) >= 0.55 OR len(st.taken) = len(s) THEN 'variant' ELSE 'different' END AS verdict,
  CASE WHEN len(s) = 0 THEN false ELSE len(st.taken) = len(s) END AS subset
FROM (SELECT *, CASE WHEN len(s) = 0 THEN NULL ELSE {fold} END AS st
  FROM (SELECT *, CASE WHEN len({a}) <= len({b}) THEN {a} ELSE {b} END AS s,
               CASE WHEN len({a}) <= len({b}) THEN {b} ELSE {a} END AS g FROM {table}) z1) z2"""


def score_of(i: int, field: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN NULL ELSE ((conf_seed_pct + {i * 7}) % 60 + 40)::DOUBLE / 100.0::DOUBLE END"


_KEYED = f"""k AS (SELECT *, lower(trim(coalesce(khasra_number, ''))) AS khasra_key,
  lower(trim(coalesce(khata_number, ''))) AS khata_key, {place('village')} AS village_key,
  {place('district')} AS district_key, {toks('owner_name')} AS owner_key FROM v_records),
places AS (SELECT DISTINCT village_key, district_key FROM k),
pp AS (SELECT a.village_key AS va, a.district_key AS da, b.village_key AS vb, b.district_key AS db
  FROM places a, places b WHERE {sim('a.village_key', 'b.village_key')} >= 0.85
  AND {sim('a.district_key', 'b.district_key')} >= 0.85),
conf AS ({' UNION ALL '.join(
    f"SELECT document_id, {i} AS i, '{f}' AS field, '{fixed.RECORD_LABELS[f]}' AS label, {score_of(i, f)} AS score FROM v_records"
    for i, f in FIELDS)})"""

_DUPLICATES = """dup AS (SELECT a.document_id, min(b.document_id) AS duplicate_of FROM k a
  JOIN pp ON a.village_key = va AND a.district_key = da
  JOIN k b ON b.khasra_key = a.khasra_key AND b.village_key = vb AND b.district_key = db
    AND b.status = 'VERIFIED' AND b.document_id <> a.document_id
  WHERE a.khasra_key <> '' GROUP BY a.document_id)"""

_CONFLICTS = f"""cand AS (SELECT a.document_id, b.document_id AS other, a.owner_key AS ka, b.owner_key AS kb, b.owner_name AS conflict_owner
  FROM k a JOIN pp ON a.village_key = va AND a.district_key = da
  JOIN k b ON b.khata_key = a.khata_key AND b.village_key = vb AND b.district_key = db
    AND b.status = 'VERIFIED' AND b.document_id <> a.document_id AND b.owner_name IS NOT NULL
  WHERE a.khata_key <> ''),
spelled AS (SELECT DISTINCT ka, kb FROM cand),
judged AS ({compared('spelled', 'ka', 'kb')}),
firsts AS (SELECT document_id, min(other) AS other FROM cand JOIN judged USING (ka, kb) WHERE verdict <> 'same' GROUP BY document_id),
conflict AS (SELECT c.document_id, c.other AS conflict_with, c.conflict_owner, j.score, j.verdict, j.subset
  FROM cand c JOIN firsts USING (document_id, other) JOIN judged j USING (ka, kb))"""

AREA = "try_cast(nullif(regexp_extract(plot_area, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DOUBLE)"

_PAGE = f"""miss AS ({' UNION ALL '.join(
    f"SELECT document_id, {n} AS pos, '{f}' AS field, 'missing' AS kind, 'missing' AS code, '{fixed.RECORD_LABELS[f]} is missing' AS issue "
    f"FROM v_records WHERE coalesce(trim({f}), '') = ''"
    for n, f in enumerate(fixed.REQUIRED_RECORD_FIELDS))}),
rng AS (SELECT document_id, 10 AS pos, 'plot_area' AS field, 'range' AS kind,
  CASE WHEN a IS NULL THEN 'plotNotNumber' WHEN a <= 0 THEN 'plotZero' WHEN a < 0.0001 THEN 'plotTooSmall' ELSE 'plotTooLarge' END AS code,
  CASE WHEN a IS NULL THEN {said(fixed.TEXTS['plotNotNumber'], value='plot_area')} WHEN a <= 0 THEN '{fixed.TEXTS['plotZero']}'
       ELSE {said(fixed.TEXTS['plotTooLarge'], area='CAST(CAST(a AS BIGINT) AS VARCHAR)', max="'10000'")} END AS issue
  FROM (SELECT *, {AREA} AS a FROM v_records) z WHERE plot_area <> '' AND (a IS NULL OR a <= 0 OR a < 0.0001 OR a > 10000)
  UNION ALL SELECT document_id, 11, 'owner_name', 'range', 'ownerDigits', '{fixed.TEXTS['ownerDigits']}'
  FROM v_records WHERE regexp_matches(owner_name, '[0-9]')),
low AS (SELECT document_id, 20 + i AS pos, field, 'confidence' AS kind, 'lowConfidence' AS code,
  {said(fixed.TEXTS['lowConfidence'], pct='CAST(CAST(floor(score * 100 + 0.5) AS BIGINT) AS VARCHAR)')} AS issue
  FROM conf WHERE score < 0.75)"""

_LEAD = f"""lead AS (SELECT k.document_id, -1 AS pos, 'khasra_number' AS field, 'duplicate' AS kind,
  CASE WHEN o.ulpin IS NULL THEN 'duplicate' ELSE 'duplicateUlpin' END AS code,
  CASE WHEN o.ulpin IS NULL THEN {said(fixed.TEXTS['duplicate'], khasra='k.khasra_number', village='k.village')}
       ELSE {said(fixed.TEXTS['duplicateUlpin'], khasra='k.khasra_number', village='k.village', ulpin='o.ulpin')} END AS issue
  FROM dup JOIN k ON k.document_id = dup.document_id JOIN v_records o ON o.document_id = duplicate_of
  UNION ALL SELECT k.document_id, -1, 'owner_name',
  CASE WHEN verdict = 'different' THEN 'ownerConflict' ELSE 'ownerVariant' END,
  CASE WHEN verdict = 'different' THEN 'ownerConflict' WHEN subset THEN 'ownerIncomplete' ELSE 'ownerVariant' END,
  CASE WHEN verdict = 'different' THEN {said(fixed.TEXTS['ownerConflict'], khata='khata_number', owner='conflict_owner')}
       WHEN subset THEN {said(fixed.TEXTS['ownerIncomplete'], khata='khata_number', owner='conflict_owner', pct='CAST(CAST(floor(score * 100 + 0.5) AS BIGINT) AS VARCHAR)')}
       ELSE {said(fixed.TEXTS['ownerVariant'], khata='khata_number', owner='conflict_owner', pct='CAST(CAST(floor(score * 100 + 0.5) AS BIGINT) AS VARCHAR)')} END
  FROM conflict c JOIN k ON k.document_id = c.document_id WHERE NOT EXISTS (SELECT 1 FROM dup WHERE dup.document_id = k.document_id)),
found AS (SELECT * FROM lead UNION ALL SELECT * FROM miss UNION ALL SELECT * FROM rng UNION ALL SELECT * FROM low),
checked AS (SELECT r.*, d.duplicate_of, coalesce(n, 0) AS n, top_issue,
  CASE WHEN d.document_id IS NOT NULL THEN 'DUPLICATE' WHEN coalesce(n, 0) > 0 THEN 'FLAGGED' ELSE 'PASS' END AS validation_status
  FROM v_records r LEFT JOIN dup d USING (document_id)
  LEFT JOIN (SELECT document_id, count(*) AS n, arg_min(issue, pos) AS top_issue FROM found GROUP BY document_id) f USING (document_id))"""

PENALTY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.PENALTY.items()) + " ELSE 0 END"

_SCORE = f"""present AS ({' UNION ALL '.join(
    f"SELECT document_id, {i} AS i, '{f}' AS field, {score_of(i, f)} AS score FROM v_records WHERE coalesce(trim({f}), '') <> ''"
    for i, f in FIELDS)}),
parts AS (SELECT document_id, count(*) AS present, list_reduce(list(score ORDER BY i), lambda a, b: a + b, 0.0::DOUBLE) / count(*) AS mean_score,
  count(*) FILTER (score < 0.75) AS unsure FROM present GROUP BY document_id),
costs AS (SELECT document_id, sum({PENALTY}) AS cost FROM found GROUP BY document_id),
comp AS (SELECT r.*, CAST(floor(present * 100.0::DOUBLE / 9 + 0.5) AS BIGINT) AS completeness,
  CAST(floor(mean_score * (1.0::DOUBLE - 0.5::DOUBLE * (unsure::DOUBLE / present::DOUBLE)) * 100.0::DOUBLE + 0.5) AS BIGINT) AS confidence_score,
  CAST(greatest(0, 100 - coalesce(cost, 0)) AS BIGINT) AS consistency
  FROM checked r JOIN parts USING (document_id) LEFT JOIN costs USING (document_id)),
scored AS (SELECT *, CAST(floor((completeness * 30 + confidence_score * 30 + consistency * 40) / 100.0::DOUBLE + 0.5) AS BIGINT) AS quality_score FROM comp)"""


def records_with(*parts: str) -> str:
    """WITH clause on the records: keyed, duplicates, conflicts, page, lead, score."""
    known = {
        "duplicates": _DUPLICATES, "conflicts": _CONFLICTS, "page": _PAGE, "lead": _LEAD, "score": _SCORE,
    }
    return ",\n".join([oracle_with("v_records"), _KEYED, *[known[p] for p in parts]])


VALIDATED = records_with("duplicates", "conflicts", "page", "lead")
SCORED = records_with("duplicates", "conflicts", "page", "lead", "score")
