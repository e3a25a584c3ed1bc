"""Queries for lists, dashboard figures, district risk and the map."""

from __future__ import annotations

from pyspark.sql import functions as F

from landledger import fixed
from landledger.catalog import query
from landledger.catalog.sqlparts import SCORED, VALIDATED, records_with
from landledger.operators import cadastral, listings, quality, risk, stats, validate
from landledger.plans import dashboard, views
from landledger.plans.views import NOW, oracle_with

REC = oracle_with("v_records")
DOC = f"""{REC}, docs AS (SELECT document_id, 'Scan ' || document_id || '.pdf' AS filename, status, CASE WHEN document_id % 10 = 0 THEN 'MUTATION_ORDER' ELSE 'KHATAUNI' END AS document_kind,
  created_at, created_at + CAST(document_id % 24 AS INTEGER) * INTERVAL 1 HOUR AS updated_at, ulpin, district, village FROM v_records)"""


def documents(spark, sf):
    return views.records(spark, sf).selectExpr(
        "document_id", "concat('Scan ', document_id, '.pdf') as filename", "status",
        "if(document_id % 10 = 0, 'MUTATION_ORDER', 'KHATAUNI') as document_kind", "created_at",
        "created_at + make_interval(0, 0, 0, 0, cast(document_id % 24 as int)) as updated_at", "ulpin", "district", "village",
    )


def page_checked(spark, sf):
    """Records with the findings their page alone gives."""
    return views.records(spark, sf).withColumn("issues", F.expr(validate.page_findings())).withColumn(
        "validation_status", F.expr("if(size(issues) > 0, 'FLAGGED', 'PASS')")
    )


def wide(spark, sf):
    """Documents with record or order reading, and validation; every tenth page is an order."""
    checked = page_checked(spark, sf)
    return stats.document_wide(
        documents(spark, sf).drop("district", "village", "ulpin"),
        checked.filter("document_id % 10 <> 0").select("document_id", "village", "district"),
        checked.filter("document_id % 10 = 0").select("document_id", "village", "district"),
        checked.select("document_id", "validation_status", "issues"),
    )


_PAGE = f"""{records_with('page')}, docs AS (SELECT document_id, 'Scan ' || document_id || '.pdf' AS filename, status, CASE WHEN document_id % 10 = 0 THEN 'MUTATION_ORDER' ELSE 'KHATAUNI' END AS document_kind,
  created_at, created_at + CAST(document_id % 24 AS INTEGER) * INTERVAL 1 HOUR AS updated_at, district, village FROM v_records),
pf AS (SELECT * FROM miss UNION ALL SELECT * FROM rng UNION ALL SELECT * FROM low),
tops AS (SELECT document_id, count(*) AS n, arg_min(issue, pos) AS top_issue FROM pf GROUP BY document_id),
listed AS (SELECT docs.*, coalesce(n, 0) AS issue_count, top_issue FROM docs LEFT JOIN tops USING (document_id))"""


# --- lists ---------------------------------------------------------------

@query(f"{DOC} SELECT document_id, filename, status, district, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%g') AS updated_at FROM docs WHERE status = 'FLAGGED' AND district = 'district north'")
def documents_list(spark, sf):
    return listings.documents_list(documents(spark, sf), "FLAGGED", "district north")


@query(f"{_PAGE} SELECT document_id, document_kind, coalesce(district, '') AS district, issue_count FROM listed")
def document_wide(spark, sf):
    return wide(spark, sf).selectExpr(
        "document_id", "document_kind", f"{stats.place_of_document()} as district",
        "cast(size(validation.issues) as bigint) as issue_count",
    )


@query(f"{DOC} SELECT document_id, district FROM docs")
def place_of_document(spark, sf):
    return wide(spark, sf).selectExpr("document_id", f"{stats.place_of_document()} as district")


@query(f"{_PAGE} SELECT document_id, filename, status, village, district, issue_count, top_issue FROM listed WHERE status IN ('PENDING', 'FLAGGED')")
def review_queue(spark, sf):
    return listings.review_queue(wide(spark, sf)).drop("updated_at")


@query(f"{DOC} SELECT document_id FROM docs WHERE status = 'FLAGGED' AND district = 'district east' AND (lower(filename) LIKE '%77%' OR lower(village) LIKE '%77%' OR lower(district) LIKE '%77%')")
def queue_search(spark, sf):
    return listings.queue_search(listings.review_queue(wide(spark, sf)), "FLAGGED", "district east", " 77 ").select("document_id")


@query(f"""{_PAGE} SELECT document_id, CASE WHEN document_kind = 'MUTATION_ORDER' THEN 'order' ELSE 'flagged' END AS notice, filename, village || ' · ' || district AS place, top_issue AS finding
FROM listed WHERE (document_kind = 'MUTATION_ORDER' AND status IN ('PENDING', 'FLAGGED')) OR (document_kind = 'KHATAUNI' AND status = 'FLAGGED') ORDER BY updated_at DESC, document_id LIMIT 30""")
def notices(spark, sf):
    return listings.notices(wide(spark, sf)).drop("updated_at")


@query(f"{DOC} SELECT document_id, filename, status FROM docs WHERE district = 'district west' ORDER BY updated_at DESC, document_id LIMIT 12")
def recent_activity(spark, sf):
    return listings.recent_activity(documents(spark, sf), "district west").select("document_id", "filename", "status")


@query(f"{DOC}, page AS (SELECT document_id, ulpin FROM docs WHERE ulpin IS NOT NULL AND status = 'VERIFIED' AND document_id > 100 ORDER BY document_id LIMIT 25) SELECT *, (SELECT max(document_id) FROM page) AS next_cursor FROM page")
def records_page(spark, sf):
    return listings.records_page(views.records(spark, sf), cursor=100).select("document_id", "ulpin", "next_cursor")


@query(f"{REC} SELECT document_id, ulpin FROM v_records WHERE status = 'VERIFIED' AND ulpin IN (SELECT 'UP' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') FROM customer)")
def lookup_by_reference(spark, sf):
    asked = views.base(spark, sf, "customer").selectExpr("concat(' up', lpad(c_custkey, 12, '0'), ' ') as reference")
    return listings.lookup_by_reference(asked, views.records(spark, sf)).select("document_id", "ulpin")


@query(f"""{records_with('duplicates')} SELECT dup.document_id, duplicate_of, 'Scan ' || duplicate_of || '.pdf' AS duplicate_filename, o.ulpin AS duplicate_ulpin
FROM dup JOIN v_records o ON o.document_id = duplicate_of""")
def duplicate_pointer(spark, sf):
    found = validate.duplicate_parcels(views.records(spark, sf)).select("document_id", "duplicate_of")
    return listings.duplicate_pointer(found, documents(spark, sf))


@query(f"{DOC} SELECT document_id FROM docs WHERE status <> 'REJECTED'")
def working_set(spark, sf):
    return stats.working_set(documents(spark, sf)).select("document_id")


# --- counts and means ----------------------------------------------------

@query(f"{DOC} SELECT status, count(*) AS documents, status IN ('PENDING', 'FLAGGED', 'VERIFIED', 'REJECTED') AS is_processed FROM docs GROUP BY status")
def status_counts(spark, sf):
    return stats.status_counts(documents(spark, sf))


@query(f"{REC} SELECT district, count(*) AS records FROM v_records GROUP BY district")
def district_counts(spark, sf):
    return stats.district_counts(views.records(spark, sf))


@query(f"{records_with()} SELECT count(score) AS readings, round(avg(score), 9) AS mean_confidence FROM conf")
def mean_confidence(spark, sf):
    return stats.mean_confidence(views.records(spark, sf)).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(f"""{records_with()}, v AS (SELECT document_id, list(score ORDER BY i) FILTER (score IS NOT NULL) AS s FROM conf GROUP BY document_id)
SELECT document_id, list_reduce(s, lambda a, b: a + b, 0.0::DOUBLE) / len(s) AS confidence FROM v""")
def record_confidence(spark, sf):
    return views.records(spark, sf).selectExpr("document_id", f"{stats.record_confidence()} as confidence")


@query(f"{SCORED} SELECT count(*) AS scored, CAST(floor(avg(quality_score) + 0.5) AS BIGINT) AS mean_quality, count(*) FILTER (quality_score < 70) AS low_quality FROM scored")
def quality_summary(spark, sf):
    return stats.quality_summary(quality.quality_score(validate.validate_records(views.records(spark, sf))))


@query(f"""{DOC}, a AS (SELECT user_id AS document_id, count(*) AS edits FROM events WHERE event_type = 'click' GROUP BY user_id),
v AS (SELECT count(*) AS records, coalesce(CAST(sum(edits) AS BIGINT), 0) AS corrected FROM docs LEFT JOIN a USING (document_id) WHERE status = 'VERIFIED' AND document_kind = 'KHATAUNI')
SELECT records, records * 9 AS total, greatest(0, records * 9 - corrected) AS accepted FROM v""")
def field_acceptance(spark, sf):
    trail = views.base(spark, sf, "events").selectExpr(
        "user_id as document_id", "if(event_type = 'click', 'EDIT_FIELD', event_type) as action"
    )
    return stats.field_acceptance(documents(spark, sf), trail)


@query(f"""{VALIDATED} SELECT count(*) FILTER (status <> 'REJECTED' AND validation_status = 'PASS') AS pass, count(*) FILTER (status <> 'REJECTED' AND validation_status = 'FLAGGED') AS flagged,
count(*) FILTER (status <> 'REJECTED' AND validation_status = 'DUPLICATE') AS duplicate, count(*) FILTER (status IN ('UPLOADED', 'PROCESSING')) AS not_read FROM checked""")
def validation_results(spark, sf):
    return stats.validation_results(documents(spark, sf), validate.validate_records(views.records(spark, sf)))


_CATEGORY = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in fixed.CATEGORY_OF.items()) + " END"
_CATEGORY_LIST = "(VALUES " + ", ".join(f"('{c}', {n})" for n, c in enumerate(fixed.ERROR_CATEGORIES)) + ") AS cl(category, place)"


@query(f"""{VALIDATED}, n AS (SELECT {_CATEGORY} AS category, count(DISTINCT document_id) AS records FROM found JOIN v_records USING (document_id) WHERE status <> 'REJECTED' GROUP BY 1)
SELECT category, CAST(place AS BIGINT) AS place, coalesce(records, 0) AS records FROM {_CATEGORY_LIST} LEFT JOIN n USING (category)""")
def error_categories(spark, sf):
    return stats.error_categories(stats.working_set(validate.validate_records(views.records(spark, sf))))


RISK = """g AS (SELECT district, count(*) AS record_count, CAST(floor(avg(quality_score) + 0.5) AS BIGINT) AS mean_quality, count(*) FILTER (band = 'LOW') AS low_quality_count,
  count(*) FILTER (matched_count > 0) AS reconciled, count(*) FILTER (matched_count > 0 AND reconciliation = 'CONFLICTS') AS reconciliation_conflicts,
  count(*) FILTER (chain_status <> 'EMPTY') AS chains_traced, count(*) FILTER (chain_status = 'DEFECTS') AS chain_defects,
  count(*) FILTER (chain_status <> 'EMPTY' AND critical > 0) AS critical_chain_defects,
  count(*) FILTER ((band = 'LOW' AND coalesce(contradicted, true)) OR reconciliation = 'CONFLICTS' OR critical > 0) AS needs_field_verification FROM scored GROUP BY district),
risk AS (SELECT *, CASE WHEN reconciled = 0 THEN 0.0::DOUBLE ELSE floor(reconciliation_conflicts / reconciled::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS reconciliation_conflict_rate,
  CASE WHEN chains_traced = 0 THEN 0.0::DOUBLE ELSE floor(critical_chain_defects / chains_traced::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS chain_defect_rate FROM g)"""
_RISK_INPUT = f"""{REC}, scored AS (SELECT district, conf_seed_pct AS quality_score, CASE WHEN conf_seed_pct >= 90 THEN 'HIGH' WHEN conf_seed_pct >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  document_id % 4 AS matched_count, CASE WHEN document_id % 4 = 0 THEN 'NOT_FOUND' WHEN document_id % 9 = 0 THEN 'CONFLICTS' ELSE 'AGREES' END AS reconciliation,
  CASE document_id % 3 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'CLEAN' ELSE 'DEFECTS' END AS chain_status, CASE WHEN document_id % 15 = 2 THEN 1 ELSE 0 END AS critical,
  CASE document_id % 7 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS contradicted FROM v_records WHERE status <> 'REJECTED'),
{RISK}"""


def risk_input(spark, sf):
    """Scores and evidence outcomes of every record, spread evenly over all cases."""
    return views.view(spark, sf, "v_records").filter("status <> 'REJECTED'").selectExpr(
        "district", "conf_seed_pct as quality_score", f"{quality.band_of('conf_seed_pct')} as band",
        "document_id % 4 as matched_count",
        "case when document_id % 4 = 0 then 'NOT_FOUND' when document_id % 9 = 0 then 'CONFLICTS' else 'AGREES' end as reconciliation",
        "elt(int(document_id % 3) + 1, 'EMPTY', 'CLEAN', 'DEFECTS') as chain_status", "if(document_id % 15 = 2, 1, 0) as critical",
        "case document_id % 7 when 0 then null when 1 then true else false end as contradicted",
    )


@query(f"{_RISK_INPUT} SELECT * FROM risk")
def district_risk(spark, sf):
    return risk.district_risk(risk_input(spark, sf))


_PLACES = {"district north": (80.0, 27.0), "district south": (81.0, 25.0), "district east": (83.0, 26.0)}


@query(f"""{_RISK_INPUT}, s AS (SELECT district, record_count, needs_field_verification, needs_field_verification / record_count::DOUBLE AS share FROM risk)
SELECT *, CASE district WHEN 'district north' THEN 80.0::DOUBLE WHEN 'district south' THEN 81.0::DOUBLE WHEN 'district east' THEN 83.0::DOUBLE END AS longitude,
CASE district WHEN 'district north' THEN 27.0::DOUBLE WHEN 'district south' THEN 25.0::DOUBLE WHEN 'district east' THEN 26.0::DOUBLE END AS latitude,
CASE WHEN share >= 0.5 THEN 'high' WHEN share >= 0.25 THEN 'mid' WHEN share > 0 THEN 'low' ELSE 'none' END AS tone, district <> 'district west' AS placed FROM s""")
def visit_share(spark, sf):
    return risk.visit_share(risk.district_risk(risk_input(spark, sf)), _PLACES)


@query(f"{_RISK_INPUT} SELECT CAST(sum(needs_field_verification) AS BIGINT) AS visits FROM risk")
def visits_total(spark, sf):
    return risk.visits_total(risk.district_risk(risk_input(spark, sf)))


@query(f"""{_RISK_INPUT.replace(REC, VALIDATED, 1)},
n AS (SELECT {_CATEGORY} AS category, count(DISTINCT document_id) AS records FROM found JOIN v_records USING (document_id) WHERE status <> 'REJECTED' GROUP BY 1),
l AS (SELECT CAST(sum(reconciliation_conflicts) AS BIGINT) AS conflicts, CAST(sum(chain_defects) AS BIGINT) AS defects FROM risk)
SELECT category, CAST(place AS BIGINT) AS place, coalesce(records, 0) + CASE category WHEN 'otherSystems' THEN conflicts WHEN 'chain' THEN defects ELSE 0 END AS records FROM {_CATEGORY_LIST} LEFT JOIN n USING (category), l""")
def error_totals_live(spark, sf):
    stored = stats.error_categories(stats.working_set(validate.validate_records(views.records(spark, sf))))
    return stats.error_totals_live(stored, risk.district_risk(risk_input(spark, sf)))


@query(f"""{VALIDATED} SELECT r.document_id, coalesce(bool_or(kind IN ('duplicate', 'ownerConflict', 'sourceConflict', 'sourceStale', 'chainDefect')), false) AS contradicted
FROM v_records r LEFT JOIN found USING (document_id) GROUP BY r.document_id""")
def contradicted_flag(spark, sf):
    return validate.validate_records(views.records(spark, sf)).selectExpr("document_id", f"{risk.contradicted_flag()} as contradicted")


@query(f"""{records_with()}, ranked AS (SELECT document_id, khasra_number, row_number() OVER (PARTITION BY khasra_key, replace(village_key, 'bur', 'pur'), district_key
  ORDER BY CASE status WHEN 'VERIFIED' THEN 0 WHEN 'PENDING' THEN 1 WHEN 'FLAGGED' THEN 2 WHEN 'PROCESSING' THEN 3 WHEN 'UPLOADED' THEN 4 ELSE 9 END, document_id) AS rn FROM k WHERE status <> 'REJECTED')
SELECT document_id FROM ranked WHERE rn = 1 OR khasra_number IS NULL""")
def parcel_best_copy(spark, sf):
    return risk.parcel_best_copy(stats.working_set(views.records(spark, sf))).select("document_id")


@query(f"""{DOC} SELECT CASE WHEN district IN ('district north', 'district south') THEN 'A' WHEN district = 'district east' THEN 'B' ELSE 'UNASSIGNED' END AS state, count(*) AS documents,
count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status IN ('PENDING', 'FLAGGED')) AS awaiting, count(DISTINCT district) AS districts FROM docs GROUP BY 1""")
def state_progress(spark, sf):
    states = {"district north": "A", "district south": "A", "district east": "B"}
    return stats.state_progress(documents(spark, sf), states)


@query(f"{DOC} SELECT document_id, CASE WHEN district IN ('district north', 'district south') THEN 'A' WHEN district = 'district east' THEN 'B' END AS state FROM docs")
def state_of(spark, sf):
    states = {"district north": "A", "district south": "A", "district east": "B"}
    padded = documents(spark, sf).withColumn("district", F.concat(F.lit("  "), "district"))
    return padded.selectExpr("document_id", f"{stats.state_of('district', states)} as state")


_TREND_NOW = "1998-06-15 20:00:00"


@query(f"""{REC}, c AS (SELECT CAST(generate_series AS DATE) AS day FROM generate_series(DATE '1998-06-03', DATE '1998-06-16', INTERVAL 1 DAY))
SELECT CAST(day AS VARCHAR) AS day, count(document_id) AS documents FROM c LEFT JOIN v_records ON CAST(created_at + INTERVAL 330 MINUTE AS DATE) = day GROUP BY day""")
def daily_trend(spark, sf):
    return stats.daily_trend(documents(spark, sf), _TREND_NOW)


@query("SELECT event_id, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS day FROM events")
def local_day(spark, sf):
    return views.base(spark, sf, "events").selectExpr("event_id", f"{stats.local_day('ts', 'Asia/Kolkata')} as day")


def job_attempts(spark, sf):
    """All events of a user and type as attempts: a job is given up after three and ends with a success."""
    key = "partition by user_id, event_type"
    turns = views.base(spark, sf, "events").selectExpr(
        "*", f"count_if(value > 90) over ({key} order by ts, event_id rows between unbounded preceding and 1 preceding) as turn"
    ).selectExpr("*", f"row_number() over ({key}, turn order by ts, event_id) - 1 as place")
    return turns.selectExpr(
        "concat_ws('-', user_id, event_type, turn, place div 3) as job_id", "user_id as document_id", "cast(place % 3 + 1 as int) as attempt",
        "value > 90 as succeeded", "concat('error ', repeat(event_type, 100)) as error",
    )


_JOBS = """t AS (SELECT *, count(*) FILTER (value > 90) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM events),
u AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, turn ORDER BY ts, event_id) - 1 AS place FROM t),
a AS (SELECT user_id || '-' || event_type || '-' || turn || '-' || (place // 3) AS job_id, user_id AS document_id, place % 3 + 1 AS attempt,
  value > 90 AS ok, 'error ' || repeat(event_type, 100) AS error FROM u),
j AS (SELECT job_id, max(document_id) AS document_id, max(attempt) AS attempts, arg_max(ok, attempt) AS ok, arg_max(error, attempt) AS error FROM a GROUP BY job_id),
jobs AS (SELECT job_id, document_id, attempts, CASE WHEN ok THEN 'DONE' WHEN attempts >= 3 THEN 'FAILED' ELSE 'QUEUED' END AS state,
  CASE WHEN ok THEN NULL ELSE substr(error, 1, 500) END AS error, CASE WHEN NOT ok AND attempts >= 3 THEN 'UPLOADED' END AS document_status FROM j)"""


@query(f"WITH {_JOBS} SELECT * FROM jobs")
def job_outcomes(spark, sf):
    return stats.job_outcomes(job_attempts(spark, sf))


@query(f"WITH {_JOBS} SELECT count(*) FILTER (state = 'QUEUED') AS queued, CAST(0 AS BIGINT) AS running, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'DONE') AS done FROM jobs")
def queue_depth(spark, sf):
    return stats.queue_depth(stats.job_outcomes(job_attempts(spark, sf)))


@query(f"""{SCORED}, t AS (SELECT count(*) FILTER (status IN ('PENDING', 'FLAGGED', 'VERIFIED', 'REJECTED')) AS total_processed,
  count(*) FILTER (status = 'PENDING') AS pending_verification, count(*) FILTER (status = 'FLAGGED') AS flagged_documents, count(*) AS scored, CAST(floor(avg(quality_score) + 0.5) AS BIGINT) AS mean_quality,
  count(*) FILTER (status = 'VERIFIED' AND document_id % 10 <> 0) AS records,
  count(*) FILTER (status <> 'REJECTED' AND validation_status = 'DUPLICATE') AS duplicate FROM scored WHERE district = 'district east')
SELECT * FROM t""")
def dashboard_stats(spark, sf):
    checked = validate.validate_records(views.records(spark, sf))
    scored = quality.quality_score(checked)
    trail = views.base(spark, sf, "events").selectExpr("user_id as document_id", "event_type as action")
    totals = dashboard.dashboard_totals(documents(spark, sf), scored, checked, trail, NOW, "district east")
    return totals.select(
        "total_processed", "pending_verification", "flagged_documents", "scored", "mean_quality", "records", "duplicate"
    )


# --- map -----------------------------------------------------------------

PLT = oracle_with("v_plots")
_OVER = """pairs AS (SELECT a.plot_id, b.plot_id AS other_id,
  greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)) / 10000.0::DOUBLE AS ha
  FROM v_plots a JOIN v_plots b ON a.village = b.village AND a.district = b.district AND a.plot_id < b.plot_id), over AS (SELECT * FROM pairs WHERE ha > 0.001)"""


@query(f"{PLT} SELECT plot_id, w * h / 10000.0::DOUBLE AS area_ha FROM v_plots")
def polygon_area(spark, sf):
    return views.plots(spark, sf).selectExpr("plot_id", f"{cadastral.polygon_area('outline')} as area_ha")


@query(f"""{PLT}, n AS (SELECT a.plot_id, greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)) / 10000.0::DOUBLE AS ha
  FROM v_plots a JOIN v_plots b ON b.plot_id = a.plot_id + 24) SELECT plot_id, round(ha, 9) AS shared_ha FROM n""")
def polygon_clip(spark, sf):
    plots = views.plots(spark, sf)
    other = plots.selectExpr("plot_id - 24 as plot_id", "outline as other")
    clipped = plots.select("plot_id", "outline").join(other, "plot_id").selectExpr(
        "plot_id", f"{cadastral.polygon_clip('outline', 'other')} as shared"
    )
    return clipped.selectExpr("plot_id", f"round(if(size(shared) < 3, 0.0D, {cadastral.polygon_area('shared')}), 9) as shared_ha")


@query(f"{PLT}, {_OVER} SELECT plot_id, other_id, round(ha, 9) AS overlap_ha FROM over")
def plot_overlaps(spark, sf):
    return cadastral.plot_overlaps(views.plots(spark, sf)).selectExpr("plot_id", "other_id", "round(overlap_ha, 9) as overlap_ha")


_CLAIMS = """claims AS (SELECT plot_id AS document_id, CASE WHEN plot_id % 13 = 0 THEN 'nowhere' ELSE village END AS village, district,
  CASE WHEN plot_id % 17 = 0 THEN '0' || khasra WHEN plot_id % 31 = 0 THEN NULL ELSE khasra END AS khasra_number,
  CASE WHEN plot_id % 11 = 0 THEN '1.2 ha' WHEN plot_id % 7 = 0 THEN CAST(w * h / 9000.0::DOUBLE AS VARCHAR) ELSE CAST(w * h / 10000.0::DOUBLE AS VARCHAR) END AS plot_area FROM v_plots)"""


def claims(spark, sf):
    """What records say about the plots: some misnamed, some measured wrong."""
    plots = views.view(spark, sf, "v_plots")
    return plots.selectExpr(
        "plot_id as document_id", "concat(if(plot_id % 13 = 0, 'nowhere', village), ' ') as village", "district",
        "case when plot_id % 17 = 0 then '0' || khasra when plot_id % 31 = 0 then null else khasra end as khasra_number",
        "case when plot_id % 11 = 0 then '1.2 ha' when plot_id % 7 = 0 then cast(w * h / 9000.0D as string) else cast(w * h / 10000.0D as string) end as plot_area",
    )


@query(f"""{PLT}, {_CLAIMS} SELECT c.document_id, c.village <> 'nowhere' AND c.khasra_number IS NOT NULL AS has_map, p.plot_id
FROM claims c LEFT JOIN v_plots p ON p.district = c.district AND p.village = c.village AND p.khasra = c.khasra_number""")
def map_lookup(spark, sf):
    return cadastral.map_lookup(claims(spark, sf), views.plots(spark, sf)).select("document_id", "has_map", "plot_id")


@query(f"""{PLT}, {_OVER}, {_CLAIMS}, n AS (SELECT plot_id, count(*) AS "overlaps" FROM (SELECT plot_id FROM over UNION ALL SELECT other_id FROM over) z GROUP BY plot_id),
j AS (SELECT c.document_id, c.village, c.khasra_number, p.plot_id, p.w * p.h / 10000.0::DOUBLE AS map_ha, try_cast(c.plot_area AS DOUBLE) AS record_ha, coalesce("overlaps", 0) AS "overlaps"
  FROM claims c LEFT JOIN v_plots p ON p.district = c.district AND p.village = c.village AND p.khasra = c.khasra_number LEFT JOIN n ON n.plot_id = p.plot_id)
SELECT document_id, plot_id, "overlaps", CASE WHEN village = 'nowhere' OR khasra_number IS NULL THEN 'NO_MAP' WHEN plot_id IS NULL THEN 'NOT_ON_MAP'
  WHEN coalesce(abs(map_ha - record_ha) / record_ha > 0.02, false) OR "overlaps" > 0 THEN 'DIFFERS' ELSE 'MATCHES' END AS map_status FROM j""")
def map_check(spark, sf):
    return cadastral.map_check(claims(spark, sf), views.plots(spark, sf)).select("document_id", "plot_id", "overlaps", "map_status")
