"""Queries on pages: reading lines, words, scripts, accuracy of what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from landledger import fixed
from landledger.catalog import ORACLES, query
from landledger.catalog.chains import ORDER_UNSURE
from landledger.catalog.records import misread
from landledger.catalog.sqlparts import FIELDS, score_of
from landledger.functions import labels
from landledger.operators import accuracy, corrections, extract, lines
from landledger.plans import intake, views
from landledger.plans.views import NOW, oracle_with
from landledger.session import settle, shared_folder
from landledger.sources import sinks
from landledger.streaming.intake import LINES, take_in

REC = oracle_with("v_records")
BLK = oracle_with("v_blocks")


# --- reading -------------------------------------------------------------

_LINE_OF = {"district": 1, "tehsil": 2, "village": 3, "khata_number": 4, "khasra_number": 5, "survey_number": 6,
            "owner_name": 7, "plot_area": 8, "land_classification": 9}


def _line_score(field: str) -> str:
    base = f"((document_id * 31) % 60 + 40 + {_LINE_OF[field]} % 3)::DOUBLE / 100.0::DOUBLE"
    bad = {"owner_name": "regexp_matches(owner_name, '[0-9]')", "plot_area": "plot_area = 'unclear'"}.get(field, "false")
    score = f"least(0.99::DOUBLE, {base} * CASE WHEN {bad} THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END)"
    return f"CASE WHEN {field} IS NULL THEN NULL ELSE floor({score} * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END"


@query(f"""{REC} SELECT document_id, {', '.join(fixed.RECORD_FIELDS)}, {_line_score('owner_name')} AS owner_confidence,
{_line_score('plot_area')} AS area_confidence, {_line_score('khasra_number')} AS khasra_confidence FROM v_records""")
def extract_fields(spark, sf):
    return extract.extract_fields(views.lines(spark, sf)).selectExpr(
        "document_id", *fixed.RECORD_FIELDS, "try_element_at(confidence, 'owner_name') as owner_confidence",
        "try_element_at(confidence, 'plot_area') as area_confidence",
        "try_element_at(confidence, 'khasra_number') as khasra_confidence",
    )


def order_lines(spark, sf, made=None):
    """The pages of mutation orders, a line per field."""
    orders = views.order_readings(spark, sf, made)
    titles = {
        "mutation_number": "Mutation No. ", "order_date": "Order date: ", "mutation_type": "Type of transfer: ",
        "from_owner": "Transferor: ", "to_owner": "Transferee - ", "share": "Share: ", "deed_number": "Deed no. ",
        "khasra_number": "Khasra No. ", "village": "Village: ", "district": "District: ",
    }
    pairs = ", ".join(f"{n + 1}, concat('{t}', {f})" for n, (f, t) in enumerate(titles.items()))
    return orders.selectExpr(
        "document_id", f"stack({len(titles) + 1}, 0, 'Mutation order', {pairs}) as (line_no, text)", "0.9D as confidence"
    ).filter("text is not null")


@query(f"{oracle_with('v_orders')} SELECT document_id, {', '.join(fixed.ORDER_FIELDS)} FROM v_orders")
def extract_order_fields(spark, sf):
    return extract.extract_order_fields(order_lines(spark, sf)).select("document_id", *fixed.ORDER_FIELDS)


@query(f"""{REC} SELECT document_id, CASE WHEN document_id % 10 = 0 THEN 'MUTATION_ORDER' ELSE 'KHATAUNI' END AS document_kind, true AS known_heading FROM v_records""")
def classify_documents(spark, sf):
    return extract.classify_documents(views.lines(spark, sf))


@query(f"{BLK} SELECT document_id, line_no, trim(substr(text, 11)) AS rest FROM v_blocks WHERE line_no = 4")
def match_label(spark, sf):
    khata = views.lines(spark, sf).withColumns({k: F.expr(v) for k, v in labels.script_flags("text").items()})
    found = labels.match_label("text", fixed.RECORD_DEVANAGARI["khata_number"], fixed.RECORD_LATIN["khata_number"])
    return khata.selectExpr("document_id", "line_no", f"trim({found}) as rest").filter("rest is not null")


@query(f"""{REC} SELECT document_id, CASE WHEN plot_area = 'unclear' THEN 'unclear' ELSE plot_area END AS area FROM v_records""")
def clean_value(spark, sf):
    dirty = views.records(spark, sf).selectExpr("document_id", "concat(' :- ', plot_area, ' hectare |.') as raw")
    cleaned = labels.clean_value("raw", fixed.RECORD_DEVANAGARI["plot_area"], labels.shape_of("plot_area"), True)
    # Speckle behind a unit hides the unit, as on a page; the shape picks the number out.
    return dirty.selectExpr("document_id", f"regexp_replace({cleaned}, ' hectare$', '') as area")


@query(f"""{REC} SELECT document_id, floor(least(0.99::DOUBLE, conf_seed_pct::DOUBLE / 100.0::DOUBLE * CASE WHEN regexp_full_match(plot_area, '[0-9]{{1,5}}([.][0-9]{{1,4}})?') THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS score FROM v_records""")
def shape_confidence(spark, sf):
    rows = views.view(spark, sf, "v_records").selectExpr("document_id", "plot_area", "double(conf_seed_pct) / 100.0D as c")
    return rows.selectExpr("document_id", f"{labels.shape_confidence('plot_area', 'c', labels.shape_of('plot_area'))} as score")


# --- words ---------------------------------------------------------------

def words(spark, sf):
    """The words of every line at their place on the page, in the order they were read."""
    return views.lines(spark, sf).selectExpr(
        "document_id", "line_no", "confidence", "posexplode(split(text, ' ')) as (i, text)"
    ).selectExpr(
        "document_id", "line_no * 100 + i as word_no", "text", "confidence * 100 as confidence",
        "i * 60.0D as x", "line_no * 40.0D + (i % 3) * 2 as y", "20.0D as height",
    )


@query(f"""{BLK} SELECT document_id, CAST(line_no * 100 + generate_subscripts(p, 1) - 1 AS BIGINT) AS word_no, unnest(p) AS text
FROM (SELECT document_id, line_no, string_split(text, ' ') AS p FROM v_blocks) z""")
def words_dedupe(spark, sf):
    # Each word is read twice more, less surely and a little off its place.
    readings = ", ".join(
        f"struct(word_no + {n * 5000} as word_no, confidence - {n} as confidence, x + {n * 7} as x, y - {n * 3} as y)" for n in range(3)
    )
    read = words(spark, sf).selectExpr("document_id", "text", "height", f"inline(array({readings}))")
    kept = lines.words_dedupe(read)
    return kept.select("document_id", "word_no", "text")


@query(f"""{BLK}, w AS (SELECT document_id, line_no, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i, confidence_dec FROM v_blocks),
u AS (SELECT *, lag(word) OVER (PARTITION BY document_id, line_no ORDER BY i) AS before FROM w),
l AS (SELECT document_id, line_no, string_agg(word, ' ' ORDER BY i) AS text, round(min(confidence_dec::DOUBLE), 4) AS confidence FROM u WHERE before IS NULL OR before <> word GROUP BY ALL)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY line_no) - 1 AS line_no, text, confidence FROM l""")
def words_to_lines(spark, sf):
    return lines.words_to_lines(words(spark, sf))


_LETTERS = {"Latin": "[A-Za-z\\x{00C0}-\\x{024F}]", "Devanagari": "[\\x{0900}-\\x{097F}]"}


@query(f"""WITH n AS (SELECT doc_id AS document_id, len(regexp_extract_all(text, '{_LETTERS['Latin']}')) AS latin, len(regexp_extract_all(text, '{_LETTERS['Devanagari']}')) AS deva FROM documents)
SELECT document_id, CASE WHEN latin = 0 AND deva = 0 THEN NULL WHEN deva >= latin THEN 'Devanagari' ELSE 'Latin' END AS script, greatest(latin, deva) AS letters,
CASE WHEN greatest(latin, deva) = 0 OR greatest(latin, deva) < 1.5::DOUBLE * least(latin, deva) THEN 'hin' WHEN deva >= latin THEN 'hin' ELSE 'eng' END AS language FROM n""")
def script_histogram(spark, sf):
    return extract.script_histogram(views.base(spark, sf, "documents").selectExpr("doc_id as document_id", "text"))


# --- accuracy ------------------------------------------------------------

_READS = f"""{REC}, r AS (SELECT *, CASE WHEN document_id % 4 = 0 THEN replace(village, 'pur', 'purr') ELSE village END AS rv,
  CASE WHEN document_id % 9 = 0 THEN replace(district, 'district', 'distrikt') ELSE district END AS rd FROM v_records),
t AS ({' UNION ALL '.join(
    f"SELECT document_id, '{f}' AS field, {f} AS truth, {dict(village='rv', district='rd').get(f, f)} AS got, {score_of(i, f)} AS score FROM r WHERE {f} IS NOT NULL"
    for i, f in FIELDS)})"""


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0 ELSE CAST(floor({part} * 100.0::DOUBLE / {whole} + 0.5) AS BIGINT) END"


@query(f"""{_READS}, a AS (SELECT field, count(*) AS total, count(*) FILTER (got <> '') AS populated, count(*) FILTER (got = truth) AS exact,
  count(*) FILTER (got <> truth) AS wrong, count(*) FILTER (got <> truth AND (score IS NULL OR score < 0.75)) AS wrong_flagged FROM t GROUP BY ROLLUP (field))
SELECT *, {_pct('populated', 'total')} AS populated_pct, {_pct('exact', 'total')} AS exact_pct, {_pct('wrong_flagged', 'wrong')} AS wrong_flagged_pct FROM a""")
def extraction_accuracy(spark, sf):
    records = views.records(spark, sf)
    return accuracy.extraction_accuracy(records, misread(records))


@query(f"""{_READS}, halves AS (SELECT document_id, row_number() OVER (ORDER BY document_id) <= (SELECT count(*) FROM v_records) // 2 AS training FROM v_records),
s AS (SELECT t.*, training FROM t JOIN halves USING (document_id)),
taught AS (SELECT field, lower(trim(got)) AS wrong_value, arg_max(truth, document_id) AS fix, count(*) AS times FROM s WHERE training AND got <> truth GROUP BY 1, 2),
h AS (SELECT s.*, coalesce(fix, got) AS fixed FROM s LEFT JOIN taught ON taught.field = s.field AND wrong_value = lower(trim(got)) WHERE NOT training),
x AS (SELECT count(*) AS held_out_fields, count(*) FILTER (got = truth) AS before_exact, count(*) FILTER (fixed = truth) AS after_exact,
  count(*) FILTER (got <> truth AND fixed = truth) AS gained, count(*) FILTER (got = truth AND fixed <> truth) AS regressed FROM h)
SELECT x.*, (SELECT CAST(sum(times) AS BIGINT) FROM taught) AS taught, (SELECT count(*) FROM taught) AS distinct_entries,
  (SELECT count(*) FROM halves WHERE training) AS train_documents, (SELECT count(*) FROM halves WHERE NOT training) AS test_documents,
  {_pct('before_exact', 'held_out_fields')} AS before_pct, {_pct('after_exact', 'held_out_fields')} AS after_pct, after_exact - before_exact AS net_fields FROM x""")
def correction_memory_holdout(spark, sf):
    records = views.records(spark, sf)
    return accuracy.correction_memory_holdout(records, misread(records))


@query(f"""{REC} SELECT CASE WHEN document_id % 30 = 0 THEN 'KHATAUNI' WHEN document_id % 10 = 0 THEN 'MUTATION_ORDER' ELSE 'KHATAUNI' END AS true_kind,
CASE WHEN document_id % 10 = 0 THEN 'MUTATION_ORDER' ELSE 'KHATAUNI' END AS document_kind, count(*) AS documents FROM v_records GROUP BY ALL""")
def classification_accuracy(spark, sf):
    truth = views.records(spark, sf).selectExpr(
        "document_id", "if(document_id % 30 <> 0 and document_id % 10 = 0, 'MUTATION_ORDER', 'KHATAUNI') as true_kind"
    )
    return accuracy.classification_accuracy(extract.classify_documents(views.lines(spark, sf)), truth)


_ORDER_READS = f"""{oracle_with('v_orders')}, t AS (
  SELECT 'mutation_number' AS field, mutation_number AS truth, mutation_number AS got, true AS usable FROM v_orders WHERE mutation_number IS NOT NULL
  UNION ALL SELECT 'order_date', order_date, replace(order_date, '/', '-'), true FROM v_orders WHERE order_date IS NOT NULL
  UNION ALL SELECT 'mutation_type', mutation_type, upper(mutation_type), mutation_type <> 'lease' FROM v_orders WHERE mutation_type IS NOT NULL
  UNION ALL SELECT 'from_owner', from_owner, 'shri ' || from_owner, true FROM v_orders WHERE from_owner IS NOT NULL
  UNION ALL SELECT 'to_owner', to_owner, to_owner, true FROM v_orders WHERE to_owner IS NOT NULL
  UNION ALL SELECT 'share', share, CASE share WHEN 'whole' THEN '1' ELSE share END, share <> 'some' FROM v_orders WHERE share IS NOT NULL
  UNION ALL SELECT 'deed_number', deed_number, deed_number || '9', false FROM v_orders WHERE deed_number IS NOT NULL
  UNION ALL SELECT 'khasra_number', khasra_number, khasra_number, true FROM v_orders WHERE khasra_number IS NOT NULL
  UNION ALL SELECT 'village', village, NULL, false FROM v_orders WHERE village IS NOT NULL
  UNION ALL SELECT 'district', district, district, true FROM v_orders WHERE district IS NOT NULL)"""


@query(f"""{_ORDER_READS}, a AS (SELECT field, count(*) AS total, count(*) FILTER (got = truth) AS exact, count(*) FILTER (usable) AS usable FROM t GROUP BY ROLLUP (field))
SELECT *, {_pct('exact', 'total')} AS exact_pct, {_pct('usable', 'total')} AS usable_pct FROM a""")
def order_accuracy(spark, sf):
    # Both sides are the same rows: what the view leaves open must not be decided twice.
    truth = settle(views.order_readings(spark, sf))
    reads = truth.withColumns({
        "order_date": F.expr("replace(order_date, '/', '-')"), "mutation_type": F.upper("mutation_type"),
        "from_owner": F.expr("concat('shri ', from_owner)"), "share": F.expr("if(share = 'whole', '1', share)"),
        "deed_number": F.expr("concat(deed_number, '9')"), "village": F.lit(None).cast("string"),
    })
    return accuracy.order_accuracy(truth, reads)


@query(f"""{_READS}, m AS (SELECT 'auto' AS mode, truth, got FROM t UNION ALL SELECT 'given', truth, CASE WHEN field = 'tehsil' THEN NULL ELSE truth END FROM t)
SELECT mode, count(*) AS fields, count(*) FILTER (got = truth) AS exact, count(*) FILTER (got <> '') AS populated FROM m GROUP BY mode""")
def accuracy_by_mode(spark, sf):
    records = views.records(spark, sf)
    auto = misread(records).withColumn("mode", F.lit("auto"))
    given = records.withColumn("tehsil", F.lit(None).cast("string")).withColumn("mode", F.lit("given"))
    return accuracy.accuracy_by_mode(records, auto.unionByName(given))


@query(f"""{_READS}, a AS (SELECT field, count(*) AS total, count(*) FILTER (got = truth) AS exact FROM t GROUP BY field)
SELECT field, total, exact FROM a""")
def accuracy_report_sink(spark, sf):
    records = views.records(spark, sf)
    path = f"{shared_folder(spark)}/accuracy-report-{uuid.uuid4().hex}"
    sinks.accuracy_report_sink(accuracy.extraction_accuracy(records, misread(records)), path)
    written = spark.read.schema("field string, total bigint, exact bigint").json(path)
    return written.filter("field is not null")


# --- from lines to stored rows -------------------------------------------

_TAKEN_IN = f"""{REC} SELECT document_id, district, tehsil, village, khata_number, khasra_number, survey_number, owner_name, plot_area, land_classification, 'KHATAUNI' AS document_kind
FROM v_records WHERE document_id % 10 <> 0"""
_TAKEN_COLUMNS = [*_LINE_OF, "document_kind"]


@query(f"""{REC} SELECT document_id, CASE WHEN document_id % 19 = 0 THEN 'rambur' ELSE 'rampur' END AS spelling, owner_name, khasra_number, plot_area, 'KHATAUNI' AS document_kind
FROM v_records WHERE document_id % 10 <> 0""")
def khatauni_intake(spark, sf):
    out = _khatauni(spark, sf)
    # How the village ends, as it is after correction: a misreading that stood would show.
    return out.selectExpr(
        "document_id", "concat('ram', regexp_extract(village, '[pb]ur+', 0)) as spelling", "owner_name", "khasra_number",
        "plot_area", "document_kind",
    )


def khatauni_reader(spark, sf):
    """The whole intake of khatauni pages, as a function of their lines; what officers put right in places is remembered."""
    records = views.records(spark, sf)
    read = misread(records.selectExpr("document_id", "village", "district", "village as right_village", "district as right_district"))
    memory = corrections.learn_corrections(read.selectExpr(
        "stack(2, 'village', village, right_village, 'district', district, right_district) as (field, before, after)",
        "document_id as seq",
    ))
    verified = records.filter("status = 'VERIFIED'")
    sources, parcels, mutations = views.sources(spark, sf), views.parcels(spark, sf), views.mutations(spark, sf)
    return lambda rows: intake.khatauni_intake(rows, memory, verified, sources, parcels, mutations, NOW)


def misread_lines(spark, sf):
    """The pages with places misread as often as :func:`misread` has it; the intake puts them right."""
    return views.lines_of(misread(views.view(spark, sf, "v_records")))


def _khatauni(spark, sf):
    return khatauni_reader(spark, sf)(misread_lines(spark, sf))


@query(_TAKEN_IN)
def pipeline_khatauni(spark, sf):
    return _khatauni(spark, sf).select("document_id", *_TAKEN_COLUMNS)


@query(_TAKEN_IN)
def stream_intake(spark, sf):
    """The same intake, over files of lines as they land."""
    folder = f"{shared_folder(spark)}/intake-{uuid.uuid4().hex}"
    misread_lines(spark, sf).selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in (x.split() for x in LINES.split(", "))]).repartition(
        F.col("document_id")).write.parquet(f"{folder}/in")
    taken = take_in(spark, f"{folder}/in", khatauni_reader(spark, sf), f"{folder}/out", f"{folder}/state")
    return taken.select("document_id", *_TAKEN_COLUMNS)


@query()
def khatauni_scores(spark, sf):
    return _khatauni(spark, sf).select("document_id", "status", "validation_status", "quality_score", "band")


@query(f"{oracle_with('v_orders')} SELECT document_id, {', '.join(fixed.ORDER_FIELDS)}, 'MUTATION_ORDER' AS document_kind FROM v_orders")
def orders_intake(spark, sf):
    made = views.made_once(spark, sf)
    out = intake.orders_intake(order_lines(spark, sf, made), made["v_parcels"], made["v_mutations"], NOW)
    return out.select("document_id", *fixed.ORDER_FIELDS, "document_kind")


# Lines of orders are read with a confidence of 0.9; unsure is what does not look like its field.
_UNLIKE = "+".join(f"CAST(coalesce({x}, false) AS BIGINT)" for x in ("regexp_matches(from_owner, '[0-9]')", "regexp_matches(to_owner, '[0-9]')", "NOT regexp_matches(share, '[0-9]')"))


@query(f"""WITH previews AS ({ORACLES["order_preview"].replace(ORDER_UNSURE, _UNLIKE)}), fields AS ({oracle_with('v_orders')} SELECT document_id, {', '.join(fixed.ORDER_FIELDS)} FROM v_orders)
SELECT fields.*, 'MUTATION_ORDER' AS document_kind, parcel_id, is_candidate, introduced, kinds, order_status, CASE order_status WHEN 'PASS' THEN 'PENDING' ELSE 'FLAGGED' END AS status
FROM fields JOIN previews USING (document_id)""")
def pipeline_orders(spark, sf):
    made = views.made_once(spark, sf)
    out = intake.orders_intake(order_lines(spark, sf, made), made["v_parcels"], made["v_mutations"], NOW)
    return out.selectExpr(
        "document_id", *fixed.ORDER_FIELDS, "document_kind", "parcel_id", "is_candidate", "array_join(introduced, ',') as introduced",
        "array_join(transform(issues, i -> i.kind || ','), '') as kinds", "order_status", "status",
    )
