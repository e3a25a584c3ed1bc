"""Queries on records: text, names, places, checks, scores, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from landledger import fixed
from landledger.catalog import query
from landledger.catalog.sqlparts import AREA, SCORED, VALIDATED, compared, place, records_with, said, sim, toks
from landledger.functions import names, text
from landledger.operators import corrections, decisions, findings, places, quality, reconcile, validate
from landledger.plans import views
from landledger.plans.views import NOW, oracle_with
from landledger.sources import sinks, tables

REC = oracle_with("v_records")
MARKS = "[\\x{0900}-\\x{0903}\\x{093A}-\\x{094F}\\x{0951}-\\x{0957}\\x{0962}\\x{0963}\\x{200C}\\x{200D}]"


# --- sources and sinks ---------------------------------------------------

@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def scan_tables(spark, sf):
    return tables.scan_tables(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"], "o_totalprice > 100000")


@query("SELECT event_id, coalesce(try_cast(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def json_columns(spark, sf):
    events = views.base(spark, sf, "events").select("event_id", "props")
    decoded = tables.json_columns(events, {"props": ("struct<k:bigint>", "named_struct('k', -1L)")})
    return decoded.selectExpr("event_id", "coalesce(props.k, -1L) as k")


@query("""SELECT page_id, regexp_extract(url, '[.][^./]*$') AS extension, length(html) AS length,
  CASE WHEN lower(regexp_extract(url, '[.][^./]*$')) NOT IN ('.jpg', '.jpeg', '.png', '.pdf') THEN 'type'
       WHEN length(html) = 0 THEN 'empty' WHEN length(html) > 15728640 THEN 'size' ELSE 'accepted' END AS verdict FROM pages""")
def scan_intake(spark, sf):
    pages = views.base(spark, sf, "pages").selectExpr("page_id", "url as path", "length(html) as length")
    return tables.judge_intake(pages).selectExpr(
        "page_id", "regexp_extract(path, '([.][^./]*)$', 1) as extension", "cast(length as bigint) as length",
        "case when mime_type is null then 'type' when length = 0 then 'empty' when not accepted then 'size' else 'accepted' end as verdict",
    )


@query(f"""{REC}, both_versions AS (SELECT document_id, owner_name, status, 1 AS version FROM v_records
  UNION ALL SELECT document_id, 'reread ' || owner_name, 'PENDING', 2 FROM v_records WHERE document_id % 3 = 0)
SELECT document_id, owner_name, status, CAST(version AS BIGINT) AS version FROM
  (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC) AS rn FROM both_versions) z WHERE rn = 1""")
def upsert_records(spark, sf):
    stored = views.view(spark, sf, "v_records").selectExpr("document_id", "owner_name", "status", "1 as version")
    new = stored.filter("document_id % 3 = 0").selectExpr(
        "document_id", "'reread ' || owner_name as owner_name", "'PENDING' as status", "2 as version"
    )
    return sinks.upsert_records(stored, new)


@query(f"""{REC} SELECT document_id, ulpin, khasra_number, district, {AREA} AS area, owner_name, 'scan ' || document_id AS filename
FROM v_records WHERE status = 'VERIFIED' AND ulpin IS NOT NULL""")
def registry_export(spark, sf):
    records = views.records(spark, sf)
    documents = records.selectExpr("document_id", "concat('scan ', document_id) as filename", "created_at")
    approvals = records.filter("document_id % 2 = 0").selectExpr(
        "document_id", "created_at as approved_at", "concat('u', document_id % 5) as approved_by"
    )
    actors = spark.range(5).selectExpr("concat('u', id) as actor_id", "concat('Officer ', id) as name", "'OFFICER' as role")
    out = sinks.registry_export(records, documents, approvals, actors)
    # Read back from the payload itself.
    shape = (
        "struct<ulpin:string,parcel:struct<khasraNumber:string,area:struct<value:double>>,"
        "location:struct<district:string>,holder:struct<name:string>,provenance:struct<sourceDocument:string>>"
    )
    return out.withColumn("p", F.from_json("payload", shape)).selectExpr(
        "document_id", "p.ulpin", "p.parcel.khasraNumber as khasra_number", "p.location.district as district",
        "p.parcel.area.value as area", "p.holder.name as owner_name", "p.provenance.sourceDocument as filename",
    )


# --- text and names ------------------------------------------------------

@query(f"{REC} SELECT document_id, array_to_string({toks('owner_name')}, ' ') AS tokens FROM v_records")
def name_tokens(spark, sf):
    return views.records(spark, sf).selectExpr("document_id", f"array_join({text.name_tokens('owner_name')}, ' ') as tokens")


@query(f"SELECT doc_id, md5(regexp_replace(text, '{MARKS}', '', 'g')) AS fingerprint FROM documents")
def skeleton(spark, sf):
    return views.base(spark, sf, "documents").selectExpr("doc_id", f"md5({text.skeleton('text')}) as fingerprint")


@query(f"{REC} SELECT document_id, levenshtein(owner_name, village || ' ' || district) AS edits FROM v_records WHERE owner_name IS NOT NULL")
def edit_distance(spark, sf):
    return views.records(spark, sf).filter("owner_name is not null").selectExpr(
        "document_id", "levenshtein(owner_name, village || ' ' || district) as edits"
    )


@query(f"{REC} SELECT document_id, {sim('village', 'tehsil')} AS similarity FROM v_records")
def token_similarity(spark, sf):
    return views.records(spark, sf).selectExpr("document_id", f"{names.token_similarity('village', 'tehsil')} as similarity")


@query(f"""{REC}, pairs AS (SELECT a.document_id, {toks('a.owner_name')} AS ka, {toks('b.owner_name')} AS kb
  FROM v_records a JOIN v_records b ON b.document_id = a.document_id + 1)
SELECT document_id, score, verdict, subset FROM ({compared('pairs', 'ka', 'kb')}) z""")
def compare_names(spark, sf):
    left = views.records(spark, sf).selectExpr("document_id", f"{text.name_key('owner_name')} as ka")
    right = views.records(spark, sf).selectExpr("document_id - 1 as document_id", f"{text.name_key('owner_name')} as kb")
    return left.join(right, "document_id").selectExpr("document_id", f"{names.compare_names('ka', 'kb')} as m").select(
        "document_id", "m.*"
    )


@query(f"{records_with()} SELECT va AS village_key, da AS district_key, vb AS other_village, db AS other_district FROM pp")
def same_place(spark, sf):
    return places.place_pairs(places.with_keys(views.records(spark, sf)))


@query(f"""{records_with()} SELECT a.document_id, b.document_id AS other FROM k a
JOIN pp ON a.village_key = va AND a.district_key = da
JOIN k b ON b.khasra_key = a.khasra_key AND b.village_key = vb AND b.district_key = db
WHERE a.khasra_key <> ''""")
def fuzzy_place_join(spark, sf):
    keys = ["khasra_key", "village_key", "district_key"]
    records = places.with_keys(views.records(spark, sf))
    other = records.select(F.col("document_id").alias("other"), *keys)
    left = records.select("document_id", *keys)
    return places.fuzzy_place_join(left, other, pairs=places.place_pairs(left)).select("document_id", "other")


# --- checks and scores ---------------------------------------------------

def _exploded(spark, sf, found: str):
    rows = views.records(spark, sf).withColumn("issues", F.expr(found))
    return findings.explode_findings(rows, ["document_id"]).select("document_id", "field", "kind", "code", "issue")


@query(f"{records_with('page')} SELECT document_id, field, kind, code, issue FROM miss")
def missing_fields(spark, sf):
    return _exploded(spark, sf, validate.missing_fields())


@query(f"{records_with('page')} SELECT document_id, field, kind, code, issue FROM rng")
def range_checks(spark, sf):
    return _exploded(spark, sf, validate.range_checks())


@query(f"{records_with('page')} SELECT document_id, field, kind, code, issue FROM low")
def confidence_checks(spark, sf):
    return _exploded(spark, sf, validate.confidence_checks())


@query(f"""{records_with()} SELECT document_id, coalesce(string_agg(field, ',' ORDER BY i) FILTER (score < 0.75), '') AS fields
FROM conf GROUP BY document_id""")
def low_confidence_fields(spark, sf):
    return views.records(spark, sf).selectExpr("document_id", f"array_join({validate.low_confidence_fields()}, ',') as fields")


@query(f"""{records_with('duplicates')} SELECT dup.document_id, duplicate_of, o.ulpin AS duplicate_ulpin
FROM dup JOIN v_records o ON o.document_id = duplicate_of""")
def duplicate_parcels(spark, sf):
    return validate.duplicate_parcels(views.records(spark, sf))


@query(f"{records_with('conflicts')} SELECT document_id, conflict_with, conflict_owner, score, verdict, subset FROM conflict")
def owner_conflicts(spark, sf):
    return validate.owner_conflicts(views.records(spark, sf))


@query(f"{VALIDATED} SELECT document_id, validation_status, duplicate_of, CAST(n AS BIGINT) AS findings, top_issue FROM checked")
def validate_records(spark, sf):
    return validate.validate_records(views.records(spark, sf)).selectExpr(
        "document_id", "validation_status", "duplicate_of", "cast(size(issues) as bigint) as findings",
        "try_element_at(issues, 1).issue as top_issue",
    )


@query(f"""{SCORED} SELECT document_id, completeness, confidence_score, consistency, quality_score,
CASE WHEN quality_score >= 90 THEN 'HIGH' WHEN quality_score >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM scored""")
def quality_score(spark, sf):
    return quality.quality_score(validate.validate_records(views.records(spark, sf))).select(
        "document_id", "completeness", "confidence_score", "consistency", "quality_score", "band"
    )


_BLANK_FIELDS = " UNION ALL ".join(
    f"SELECT document_id, {i} AS i, '{fixed.RECORD_LABELS[f]}' AS label FROM v_records WHERE coalesce(trim({f}), '') = ''"
    for i, f in enumerate(fixed.RECORD_FIELDS)
)


@query(f"""{records_with('page')}, page AS (SELECT * FROM miss UNION ALL SELECT * FROM rng),
reasons AS (
  SELECT document_id, 0 AS pos, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' field ' ELSE ' fields ' END ||
    'not extracted: ' || string_agg(label, ', ' ORDER BY i) AS reason FROM ({_BLANK_FIELDS}) b GROUP BY document_id
  UNION ALL
  SELECT document_id, 1, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' field ' ELSE ' fields ' END ||
    'read with low confidence: ' || string_agg(label, ', ' ORDER BY i) FROM conf WHERE score < 0.75 GROUP BY document_id
  UNION ALL SELECT document_id, 10 + pos, issue FROM page)
SELECT document_id, count(*) AS reasons, string_agg(reason, ' | ' ORDER BY pos) AS deductions FROM reasons GROUP BY document_id""")
def quality_deductions(spark, sf):
    checked = views.records(spark, sf).withColumn("issues", F.expr(validate.page_findings()))
    told = checked.selectExpr("document_id", f"{quality.quality_deductions()} as d")
    # Spread out, the filter stays behind the list; before it, the list would be worked out twice.
    return told.selectExpr(
        "document_id", "inline(array(struct(cast(size(d) as bigint) as reasons, array_join(d, ' | ') as deductions)))"
    ).filter("reasons > 0")


@query(f"""{VALIDATED} SELECT document_id, code, issue AS rendered FROM found""")
def render_findings(spark, sf):
    checked = validate.validate_records(views.records(spark, sf))
    rows = findings.explode_findings(checked, ["document_id"])
    return findings.render_findings(rows, findings.english_catalogue(spark), "en").select("document_id", "code", "rendered")


# --- reconciliation ------------------------------------------------------

_AREA_A, _AREA_B = AREA.replace("plot_area", "our_area"), AREA.replace("plot_area", "their_area")
MATCHED = f"""{oracle_with('v_sources')},
ks AS (SELECT *, trim(khasra_number) AS khasra, {place('village')} AS vk, {place('district')} AS dk, {toks('owner_name')} AS okey FROM v_sources),
kr AS (SELECT *, trim(khasra_number) AS khasra, {place('village')} AS vk, {place('district')} AS dk, {toks('owner_name')} AS okey FROM v_records WHERE khasra_number IS NOT NULL),
pl AS (SELECT DISTINCT vk, dk FROM kr), pp AS (SELECT a.vk AS va, a.dk AS da, b.vk AS vb, b.dk AS db FROM pl a, pl b
  WHERE {sim('a.vk', 'b.vk')} >= 0.85 AND {sim('a.dk', 'b.dk')} >= 0.85),
m AS (SELECT r.document_id, s.source, s.as_of_year, r.okey AS ka, s.okey AS kb, r.owner_name AS our_owner, s.owner_name AS their_owner,
  r.khata_number AS our_khata, s.khata_number AS their_khata, r.plot_area AS our_area, s.plot_area AS their_area,
  r.land_classification AS our_land, s.land_classification AS their_land,
  CAST(floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(make_timestamp(s.as_of_year, 1, 1, 0, 0, 0.0))) / 31557600000.0::DOUBLE) AS BIGINT) AS years
  FROM kr r JOIN pp ON r.vk = va AND r.dk = da JOIN ks s ON s.khasra = r.khasra AND s.vk = vb AND s.dk = db),
sp AS (SELECT DISTINCT ka, kb FROM m), jd AS ({compared('sp', 'ka', 'kb')}),
mm AS (SELECT *, {_AREA_A} AS a, {_AREA_B} AS b FROM m JOIN jd USING (ka, kb)),
o AS (SELECT *,
  CASE WHEN their_owner IS NULL THEN 'absent' WHEN our_owner IS NULL THEN 'differs' WHEN verdict = 'same' THEN 'agrees' WHEN verdict = 'different' THEN 'differs' ELSE 'variant' END AS o1,
  CASE WHEN their_khata IS NULL THEN 'absent' WHEN our_khata = their_khata THEN 'agrees' ELSE 'differs' END AS o2,
  CASE WHEN their_area IS NULL THEN 'absent' WHEN a IS NULL OR b IS NULL THEN (CASE WHEN our_area = their_area THEN 'agrees' ELSE 'differs' END)
       WHEN greatest(abs(a), abs(b)) = 0 THEN 'agrees' WHEN abs(a - b) / greatest(abs(a), abs(b)) <= 0.02::DOUBLE THEN 'agrees' ELSE 'differs' END AS o3,
  CASE WHEN their_land IS NULL THEN 'absent' WHEN our_land = their_land THEN 'agrees' ELSE 'differs' END AS o4 FROM mm)"""


def _tally(outcome: str) -> str:
    flags = " + ".join(f"CAST(o{i} = '{outcome}' AS BIGINT)" for i in range(1, 5))
    return f"CAST(sum({flags}) AS BIGINT)"


@query(f"""{MATCHED}, s AS (SELECT document_id, string_agg(DISTINCT source, ',' ORDER BY source) AS matched,
  {_tally('agrees')} AS agrees, {_tally('differs')} AS differs, {_tally('variant')} AS variants, {_tally('absent')} AS absent,
  count(*) FILTER (years >= 3) AS stale FROM o GROUP BY document_id)
SELECT r.document_id, coalesce(matched, '') AS matched, coalesce(agrees, 0) AS agrees, coalesce(differs, 0) AS differs,
  coalesce(variants, 0) AS variants, coalesce(absent, 0) AS absent, coalesce(stale, 0) AS stale,
  CASE WHEN s.document_id IS NULL THEN 'NOT_FOUND' WHEN differs + variants + stale > 0 THEN 'CONFLICTS' ELSE 'AGREES' END AS reconciliation
FROM v_records r LEFT JOIN s USING (document_id)""")
def reconcile_sources(spark, sf):
    return reconcile.reconcile_sources(views.records(spark, sf), views.sources(spark, sf), NOW).withColumn(
        "matched", F.array_join("matched", ",")
    )


@query(f"{MATCHED} SELECT document_id, source, years, count(*) AS copies FROM o WHERE years >= 3 GROUP BY ALL")
def stale_sources(spark, sf):
    stale = reconcile.stale_sources(views.records(spark, sf), views.sources(spark, sf), NOW)
    return stale.groupBy("document_id", "source", "years").agg(F.sum("copies").alias("copies"))


_LABEL = "CASE source WHEN 'ROR' THEN 'Record of Rights' WHEN 'REGISTRATION' THEN 'Registration' ELSE 'Cadastral survey' END"
_PCT = "CASE WHEN a IS NULL OR b IS NULL OR greatest(abs(a), abs(b)) = 0 THEN '' ELSE regexp_replace(CAST(floor(abs(a - b) / greatest(abs(a), abs(b)) * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE AS VARCHAR), '[.]0$', '') || '%' END"


@query(f"""{MATCHED}, f AS (
  SELECT document_id, source, 'owner_name' AS field, CASE WHEN our_owner IS NULL THEN 'reconMissingHere' WHEN o1 = 'differs' THEN 'reconOwnerDiffers' ELSE 'reconOwnerVariant' END AS code,
    CASE WHEN our_owner IS NULL THEN {said(fixed.TEXTS['reconMissingHere'], field="'Owner name'", source=_LABEL, value='their_owner')}
         WHEN o1 = 'differs' THEN {said(fixed.TEXTS['reconOwnerDiffers'], source=_LABEL, theirs='their_owner')}
         ELSE {said(fixed.TEXTS['reconOwnerVariant'], source=_LABEL, theirs='their_owner')} END AS issue FROM o WHERE o1 IN ('differs', 'variant')
  UNION ALL SELECT document_id, source, 'khata_number', 'reconFieldDiffers', {said(fixed.TEXTS['reconFieldDiffers'], field="'Khata number'", source=_LABEL, theirs='their_khata')} FROM o WHERE o2 = 'differs'
  UNION ALL SELECT document_id, source, 'plot_area', 'reconArea', {said(fixed.TEXTS['reconArea'], source=_LABEL, ours='our_area', theirs='their_area', pct=_PCT)} FROM o WHERE o3 = 'differs'
  UNION ALL SELECT document_id, source, 'land_classification', 'reconFieldDiffers', {said(fixed.TEXTS['reconFieldDiffers'], field="'Land classification'", source=_LABEL, theirs='their_land')} FROM o WHERE o4 = 'differs'
  UNION ALL SELECT document_id, source, 'owner_name', 'reconStale', {said(fixed.TEXTS['reconStale'], source=_LABEL, years='CAST(years AS VARCHAR)')} FROM o WHERE years >= 3)
SELECT document_id, source, field, code, issue, count(*) AS copies FROM f GROUP BY ALL""")
def reconciliation_findings(spark, sf):
    found = reconcile.reconciliation_findings(views.records(spark, sf), views.sources(spark, sf), NOW)
    rows = findings.explode_findings(found, ["document_id", "source", "copies"])
    return rows.groupBy("document_id", "source", "field", "code", "issue").agg(F.sum("copies").alias("copies"))


@query(f"""{REC}, t AS (SELECT a.document_id, a.plot_area AS our_area, b.plot_area AS their_area FROM v_records a JOIN v_records b ON b.document_id = a.document_id + 1),
u AS (SELECT *, {_AREA_A} AS a, {_AREA_B} AS b FROM t)
SELECT document_id, CASE WHEN a IS NULL OR b IS NULL THEN our_area = their_area WHEN greatest(abs(a), abs(b)) = 0 THEN true
  ELSE abs(a - b) / greatest(abs(a), abs(b)) <= 0.02::DOUBLE END AS same, {_PCT} AS detail FROM u""")
def area_compare(spark, sf):
    left = views.records(spark, sf).select("document_id", F.col("plot_area").alias("ours"))
    right = views.records(spark, sf).selectExpr("document_id - 1 as document_id", "plot_area as theirs")
    return left.join(right, "document_id").selectExpr("document_id", f"{reconcile.area_compare('ours', 'theirs')} as c").select(
        "document_id", "c.*"
    )


@query(f"""{REC} SELECT document_id, CAST(floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(created_at)) / 31557600000.0::DOUBLE) AS BIGINT) AS years FROM v_records""")
def years_since(spark, sf):
    years = reconcile.whole_years("created_at", f"timestamp'{NOW}'")
    return views.records(spark, sf).selectExpr("document_id", f"{years} as years")


HISTORY = f"""{oracle_with('v_parcels')},
kp AS (SELECT *, {place('village')} AS vk, {place('district')} AS dk FROM v_parcels),
kr AS (SELECT *, {place('village')} AS vk, {place('district')} AS dk FROM v_records),
pl AS (SELECT DISTINCT vk, dk FROM kr), pp AS (SELECT a.vk AS va, a.dk AS da, b.vk AS vb, b.dk AS db FROM pl a, pl b
  WHERE {sim('a.vk', 'b.vk')} >= 0.85 AND {sim('a.dk', 'b.dk')} >= 0.85),
history AS (SELECT r.document_id, min(p.parcel_id) AS parcel_id FROM kr r JOIN pp ON r.vk = va AND r.dk = da
  JOIN kp p ON p.khasra_number = r.khasra_number AND p.vk = vb AND p.dk = db GROUP BY r.document_id)"""


@query(f"{HISTORY} SELECT document_id, parcel_id FROM history")
def parcel_history(spark, sf):
    from landledger.operators.chain import parcel_history as operator

    return operator(views.records(spark, sf), views.parcels(spark, sf))


# --- corrections and decisions -------------------------------------------

_TRUTH_READ = f"""{REC}, misread AS (SELECT document_id, village, CASE WHEN document_id % 4 = 0 THEN replace(village, 'pur', 'purr') ELSE village END AS read_village,
  district, CASE WHEN document_id % 9 = 0 THEN replace(district, 'district', 'distrikt') ELSE district END AS read_district FROM v_records),
changes AS (SELECT 'village' AS field, read_village AS before, village AS after, document_id AS seq FROM misread
  UNION ALL SELECT 'district', read_district, district, document_id FROM misread),
taught AS (SELECT field, lower(trim(before)) AS wrong_value, arg_max(trim(after), seq) AS right_value, count(*) AS occurrences
  FROM changes WHERE length(trim(before)) >= 2 AND trim(after) <> '' AND lower(trim(before)) <> lower(trim(after)) GROUP BY 1, 2)"""


def misread(records):
    """Records as a recogniser that repeats its mistakes would read them."""
    return records.withColumns({
        "village": F.expr("if(document_id % 4 = 0, replace(village, 'pur', 'purr'), village)"),
        "district": F.expr("if(document_id % 9 = 0, replace(district, 'district', 'distrikt'), district)"),
    })


def changes_of(records):
    read = misread(records).select("document_id", F.col("village").alias("rv"), F.col("district").alias("rd"))
    return records.join(read, "document_id").selectExpr(
        "stack(2, 'village', rv, village, 'district', rd, district) as (field, before, after)", "document_id as seq"
    )


@query(f"{_TRUTH_READ} SELECT field, wrong_value, right_value, occurrences, CAST(0 AS BIGINT) AS applied FROM taught")
def learn_corrections(spark, sf):
    return corrections.learn_corrections(changes_of(views.records(spark, sf)))


@query(f"""{_TRUTH_READ} SELECT field, before, after, seq,
  (length(trim(before)) >= 2 AND trim(after) <> '' AND lower(trim(before)) <> lower(trim(after))) AS learnable FROM changes""")
def learnable(spark, sf):
    changes = changes_of(views.records(spark, sf))
    return changes.selectExpr("field", "before", "after", "seq", f"{corrections.learnable('before', 'after')} as learnable")


@query(f"""{_TRUTH_READ}, fixed_rows AS (SELECT m.document_id, coalesce(v.right_value, read_village) AS village, coalesce(d.right_value, read_district) AS district,
  CAST(v.field IS NOT NULL AS BIGINT) + CAST(d.field IS NOT NULL AS BIGINT) AS corrected,
  CASE WHEN v.field IS NULL THEN NULL ELSE floor(least(0.95::DOUBLE, greatest(((r.conf_seed_pct + 35) % 60 + 40)::DOUBLE / 100.0::DOUBLE, 0.8::DOUBLE + v.occurrences * 0.03::DOUBLE)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS village_confidence
  FROM misread m JOIN v_records r USING (document_id)
  LEFT JOIN taught v ON v.field = 'village' AND v.wrong_value = lower(trim(read_village))
  LEFT JOIN taught d ON d.field = 'district' AND d.wrong_value = lower(trim(read_district)))
SELECT document_id, village, district, corrected, village_confidence FROM fixed_rows""")
def apply_corrections(spark, sf):
    records = views.records(spark, sf)
    memory = corrections.learn_corrections(changes_of(records))
    return corrections.apply_corrections(misread(records), memory).selectExpr(
        "document_id", "village", "district", "cast(size(corrected) as bigint) as corrected",
        "if(exists(corrected, c -> c.field = 'village'), confidence['village'], null) as village_confidence",
    )


@query("""SELECT event_id, floor(least(0.95::DOUBLE, greatest(CAST(event_id % 100 AS DOUBLE) / 100.0::DOUBLE, 0.8::DOUBLE + (event_id % 7) * 0.03::DOUBLE)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS boosted FROM events""")
def learned_boost(spark, sf):
    boost = corrections.learned_boost("(cast(event_id % 100 as double) / 100.0D)", "(event_id % 7)")
    return views.base(spark, sf, "events").selectExpr("event_id", f"{boost} as boosted")


@query(f"""{_TRUTH_READ}, uses AS (SELECT count(*) AS n FROM changes JOIN taught t ON t.field = changes.field AND t.wrong_value = lower(trim(before)))
SELECT count(*) AS distinct_corrections, CAST(sum(occurrences) AS BIGINT) AS times_taught, (SELECT n FROM uses) AS times_applied FROM taught""")
def learning_totals(spark, sf):
    records = views.records(spark, sf)
    memory = corrections.learn_corrections(changes_of(records))
    return corrections.learning_totals(corrections.count_applied(memory, misread(records)))


@query(f"{REC} SELECT document_id, 'UP' || upper(substr(sha256(CAST(document_id AS VARCHAR)), 1, 12)) AS reference, coalesce(regexp_full_match(ulpin, 'UP[0-9A-F]{{12}}'), false) AS well_formed FROM v_records")
def reference_id(spark, sf):
    return views.records(spark, sf).selectExpr(
        "document_id", f"{decisions.reference_id('document_id')} as reference", f"{decisions.is_reference('ulpin')} as well_formed"
    )


def decided_on(spark, sf):
    """Decisions on waiting records: three in four approved, some with edits."""
    return views.records(spark, sf).filter("status in ('PENDING', 'FLAGGED')").selectExpr(
        "document_id", "if(document_id % 4 = 0, 'reject', 'approve') as action", "concat('u', document_id % 7) as actor_id",
        "timestamp'2026-01-01' + make_interval(0, 0, 0, cast(document_id % 40 as int)) as decided_at",
        "map_filter(map('owner_name', if(document_id % 3 = 0, '  ', concat(' ', owner_name)), 'village', "
        "if(document_id % 6 = 0, 'navipur', village)), (k, v) -> v is not null) as edited_fields",
    )


DECIDED = f"""{REC}, decided AS (SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'REJECTED' ELSE 'VERIFIED' END AS new_status, status,
  CASE WHEN document_id % 3 = 0 THEN NULL ELSE owner_name END AS new_owner, owner_name,
  CASE WHEN document_id % 6 = 0 THEN 'navipur' ELSE village END AS new_village, village,
  CASE WHEN document_id % 4 = 0 THEN ulpin ELSE coalesce(ulpin, 'UP' || upper(substr(sha256(CAST(document_id AS VARCHAR)), 1, 12))) END AS new_ulpin
  FROM v_records WHERE status IN ('PENDING', 'FLAGGED')),
changed AS (SELECT *, CAST(new_owner IS DISTINCT FROM owner_name AS BIGINT) AS e1, CAST(new_village <> village AS BIGINT) AS e2 FROM decided)"""


@query(f"""{DECIDED} SELECT document_id, new_status AS status, new_owner AS owner_name, new_village AS village, new_ulpin AS ulpin, e1 + e2 AS edits FROM changed""")
def field_decisions(spark, sf):
    return decisions.field_decisions(views.records(spark, sf), decided_on(spark, sf)).selectExpr(
        "document_id", "status", "owner_name", "village", "ulpin", "cast(size(edits) as bigint) as edits"
    )


@query(f"""{DECIDED} SELECT document_id, 0 AS entry_no, 'EDIT_FIELD' AS action, 'Owner name' AS label, NULL AS value FROM changed WHERE e1 = 1
UNION ALL SELECT document_id, e1, 'EDIT_FIELD', 'Village', new_village FROM changed WHERE e2 = 1
UNION ALL SELECT document_id, e1 + e2, CASE WHEN new_status = 'VERIFIED' THEN 'APPROVE' ELSE 'REJECT' END, NULL, new_status FROM changed""")
def audit_entries(spark, sf):
    entries = decisions.audit_entries(decisions.field_decisions(views.records(spark, sf), decided_on(spark, sf)))
    return entries.selectExpr(
        "document_id", "entry_no", "action", "get_json_object(after, '$.field') as label",
        "coalesce(get_json_object(after, '$.value'), get_json_object(after, '$.status')) as value",
    )
