"""Validation, scoring, reconciliation and risk on small fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from landledger import fixed
from landledger.operators import corrections, decisions, findings, quality, reconcile, risk, stats, validate

FIELDS = ", ".join(f"{f} string" for f in fixed.RECORD_FIELDS)
SCHEMA = f"document_id bigint, status string, ulpin string, {FIELDS}, confidence map<string,double>"
GOOD = {
    "owner_name": "रमेश कुमार वर्मा", "survey_number": "9", "khasra_number": "142/3", "khata_number": "214",
    "plot_area": "1.245", "village": "मलिहाबाद", "tehsil": "मलिहाबाद", "district": "लखनऊ", "land_classification": "सिंचित",
}
SURE = {f: 0.95 for f in fixed.RECORD_FIELDS}


def record(document_id, status="PENDING", ulpin=None, confidence=None, **changes):
    values = {**GOOD, **changes}
    return (document_id, status, ulpin, *[values[f] for f in fixed.RECORD_FIELDS], SURE if confidence is None else confidence)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_page_checks(spark):
    rows = [
        record(1), record(2, khasra_number="  ", plot_area="unclear"), record(3, plot_area="0.00001 ha"),
        record(4, plot_area="12000", owner_name="रमेश 7"), record(5, plot_area="-1", confidence={"village": 0.749}),
        record(6, survey_number=None),
    ]
    got = frame(spark, *rows).withColumn("issues", F.expr(validate.page_findings()))
    codes = {r.document_id: r.c for r in got.selectExpr("document_id", "transform(issues, i -> i.code) as c").collect()}
    assert codes == {
        1: [], 2: ["missing", "plotNotNumber"], 3: ["plotTooSmall"], 4: ["plotTooLarge", "ownerDigits"],
        5: ["plotZero", "lowConfidence"], 6: [],
    }
    text = got.filter("document_id = 3").selectExpr("issues[0].issue").first()[0]
    assert text == "Plot area 0.00001 ha is implausibly small — check the decimal point"


def test_duplicate_goes_first_and_ends_the_check(spark):
    rows = [
        record(1, "VERIFIED", "UP0123456789AB"), record(2, village="मलहिबाद", owner_name="कोई और"),
        record(3, "VERIFIED", khasra_number="7"), record(4, khasra_number="8", owner_name="कोई और"),
        record(5, khasra_number="9", owner_name="रमेश कुमार"), record(6, khasra_number="10"),
    ]
    got = {r.document_id: r for r in validate.validate_records(frame(spark, *rows)).collect()}
    assert got[2].validation_status == "DUPLICATE" and got[2].duplicate_of == 1
    assert [i.code for i in got[2].issues] == ["duplicateUlpin"]
    assert got[1].duplicate_of is None and got[1].validation_status == "PASS"
    assert [i.code for i in got[4].issues] == ["ownerConflict"]
    assert [i.code for i in got[5].issues] == ["ownerIncomplete"]
    assert got[6].validation_status == "PASS"


def test_first_look_never_changes_the_answer(spark):
    # Many spellings of one owner come first; the one stranger comes last.
    names = ["अनिल वर्मा" + "ा" * n for n in range(9)]
    rows = [record(n, "VERIFIED", khasra_number=str(n), owner_name=w) for n, w in enumerate(names)]
    rows += [record(50, "VERIFIED", khasra_number="50", owner_name="कमला देवी"), record(99, khasra_number="99", owner_name="अनिल वर्मा")]
    df = frame(spark, *rows)
    small = {tuple(r) for r in validate.owner_conflicts(df, first_look=1).collect()}
    large = {tuple(r) for r in validate.owner_conflicts(df, first_look=100).collect()}
    assert small == large and any(r[0] == 99 and r[1] == 50 for r in small)


def test_rounds_over_like_villages_equal_one_look(spark):
    rng = random.Random(21)
    people = ["अनिल वर्मा", "अनिल वर्माा", "अनील वर्मा", "कमला देवी"]
    rows = [
        record(n, rng.choice(["VERIFIED", "VERIFIED", "PENDING"]), khasra_number=str(n), khata_number=rng.choice(["7", "8"]),
               village=rng.choice(["रामपुर खुर्द कलां", "रामपुर खुर्द कला", "रामपर खुर्द कलां"]),
               owner_name=rng.choice(people[:3] if n < 150 else people) + "ा" * rng.randrange(6))
        for n in range(200)
    ]
    df = frame(spark, *rows)
    looks = [{tuple(r) for r in validate.owner_conflicts(df, first_look=n).collect()} for n in (1, 3, 10**6)]
    assert looks[0] == looks[1] == looks[2] and len(looks[0]) > 20


def test_hot_holding_gives_the_same_at_any_partitioning(spark):
    rows = [record(n, "VERIFIED" if n % 2 else "PENDING", khasra_number=str(n % 3), owner_name=f"{'राम' if n % 5 else 'श्याम'} {n % 7}")
            for n in range(300)]
    df = frame(spark, *rows)
    results = [
        sorted((r.document_id, r.duplicate_of or -1, r.issues[0].issue if r.issues else "") for r in
               validate.validate_records(df.orderBy(F.rand(n)).repartition(n)).collect())
        for n in (1, 8, 64)
    ]
    assert results[0] == results[1] == results[2]
    # Brute force: the first verified record of the same khasra, never itself.
    for document_id, duplicate, _ in results[0]:
        want = min(n for n in range(300) if n % 2 and n % 3 == document_id % 3 and n != document_id)
        assert duplicate == want


def test_quality_components(spark):
    half = {f: (0.5 if n % 2 else 0.9) for n, f in enumerate(fixed.RECORD_FIELDS)}
    rows = [record(1), record(2, confidence=half), record(3, owner_name=None, survey_number=" ", confidence={})]
    df = frame(spark, *rows).withColumn("issues", F.expr(f"if(document_id = 1, {validate.missing_fields()}, {validate.page_findings()})"))
    got = {r.document_id: r for r in quality.quality_score(df).collect()}
    assert (got[1].completeness, got[1].confidence_score, got[1].consistency, got[1].quality_score, got[1].band) == (100, 95, 100, 99, "HIGH")
    # mean (5 * 0.9 + 4 * 0.5) / 9, less half of the four in nine that are unsure
    assert got[2].confidence_score == int((6.5 / 9) * (1 - 0.5 * 4 / 9) * 100 + 0.5) and got[2].consistency == 100
    assert (got[3].completeness, got[3].confidence_score, got[3].consistency) == (78, 0, 80)
    listed = df.filter("document_id = 3").selectExpr(quality.quality_deductions()).first()[0]
    assert listed == ["2 fields not extracted: Owner name, Survey number", "Owner name is missing"]


SOURCE = (
    "source string, khasra_number string, village string, district string, owner_name string, khata_number string, "
    "plot_area string, land_classification string, as_of timestamp"
)


def source(spark, *rows):
    return spark.createDataFrame(
        [("ROR", "142/3", "मलिहाबाद", "लखनऊ", *r[:4], r[4]) for r in rows],
        SOURCE.replace("timestamp", "string"),
    ).withColumn("as_of", F.to_timestamp("as_of"))


@pytest.mark.parametrize(("row", "status", "counts"), [
    (("रमेश कुमार वर्मा", "214", "1.250", "सिंचित", "2026-01-01"), "AGREES", (4, 0, 0, 0, 0)),
    (("रमेश कुमार", "214", "1.245", None, "2026-01-01"), "CONFLICTS", (2, 0, 1, 1, 0)),
    (("मोहन लाल", "215", "1.18", "बंजर", "2026-01-01"), "CONFLICTS", (0, 4, 0, 0, 0)),
    (("रमेश कुमार वर्मा", "214", "1.245 ha", "सिंचित", "2023-09-01"), "CONFLICTS", (4, 0, 0, 0, 1)),
])
def test_reconciliation(spark, row, status, counts):
    got = reconcile.reconcile_sources(frame(spark, record(1), record(2, khasra_number="1")), source(spark, row, row), "2026-09-11")
    rows = {r.document_id: r for r in got.collect()}
    assert rows[1].reconciliation == status and rows[1].matched == ["ROR"]
    # The same row twice in a source counts twice.
    assert (rows[1].agrees, rows[1].differs, rows[1].variants, rows[1].absent, rows[1].stale) == tuple(2 * c for c in counts)
    assert rows[2].reconciliation == "NOT_FOUND"


def test_corrections_note_has_no_kind(spark):
    memory = corrections.learn_corrections(spark.createDataFrame(
        [("village", "मलहिबाद", "मलिहाबाद", 1), ("village", "मलहिबाद ", "मलिहाबाद", 2), ("district", "1", "7", 3), ("district", "Aa", "aa ", 4)],
        "field string, before string, after string, seq bigint",
    ))
    assert [tuple(r) for r in memory.collect()] == [("village", "मलहिबाद", "मलिहाबाद", 2, 0)]
    got = corrections.apply_corrections(frame(spark, record(1, village=" मलहिबाद"), record(2)), memory)
    rows = {r.document_id: r for r in got.collect()}
    assert rows[1].village == "मलिहाबाद" and rows[1].confidence["village"] == 0.95
    assert rows[1].notes[0].kind is None and rows[1].notes[0].params["count"] == "2" and rows[2].notes == []
    assert stats.error_categories(got.withColumn("issues", F.col("notes"))).agg(F.sum("records")).first()[0] == 0


def test_decisions(spark):
    edits = spark.createDataFrame(
        [(1, "approve", "u1", {"village": " नया ", "owner_name": "", "tehsil": GOOD["tehsil"]}), (2, "reject", "u1", {})],
        "document_id bigint, action string, actor_id string, edited_fields map<string,string>",
    ).withColumn("decided_at", F.to_timestamp(F.lit("2026-01-02 03:04:05.678")))
    decided = decisions.field_decisions(frame(spark, record(1, "FLAGGED"), record(2, "PENDING")), edits)
    rows = {r.document_id: r for r in decided.collect()}
    assert rows[1].village == "नया" and rows[1].owner_name is None and rows[1].status == "VERIFIED"
    assert rows[1].confidence["village"] == 1.0 and rows[1].confidence["tehsil"] == 0.95
    assert rows[2].status == "REJECTED" and rows[2].ulpin is None and len(rows[1].ulpin) == 14
    entries = decisions.audit_entries(decided).orderBy("document_id", "entry_no").collect()
    assert [(r.document_id, r.action) for r in entries] == [(1, "EDIT_FIELD"), (1, "EDIT_FIELD"), (1, "APPROVE"), (2, "REJECT")]
    assert entries[0].after == '{"field":"Owner name","value":null}'


def test_best_copy_is_greedy_over_a_chain_of_spellings(spark):
    # b resembles a and c, but a and c do not resemble each other.
    a, b, c = "aaaaaaaa", "aaaaaaab", "aaaaaabb"
    df = frame(spark, record(1, "VERIFIED", village=a), record(2, "PENDING", village=b), record(3, "FLAGGED", village=c),
               record(4, "UPLOADED", village=c), record(5, "VERIFIED", khasra_number=None), record(6, "VERIFIED", village=None))
    assert sorted(r.document_id for r in risk.parcel_best_copy(df).collect()) == [1, 3, 5, 6]


def test_risk_rates_use_what_was_checked(spark):
    rows = [("d", 50, "LOW", "NOT_FOUND", 0, "EMPTY", 0, None), ("d", 95, "HIGH", "CONFLICTS", 1, "DEFECTS", 1, False),
            ("d", 60, "LOW", "AGREES", 2, "CLEAN", 0, False), ("e", 95, "HIGH", "NOT_FOUND", 0, "EMPTY", 0, None)]
    scored = spark.createDataFrame(rows, "district string, quality_score int, band string, reconciliation string, matched_count int, chain_status string, critical int, contradicted boolean")
    got = {r.district: r for r in risk.district_risk(scored).collect()}
    assert got["d"].needs_field_verification == 2 and got["d"].reconciliation_conflict_rate == 0.5 and got["d"].mean_quality == 68
    assert got["d"].chain_defect_rate == 0.5 and got["e"].reconciliation_conflict_rate == 0.0


def test_rendering_in_another_language(spark):
    found = frame(spark, record(1, khasra_number=None)).withColumn("issues", F.expr(validate.missing_fields()))
    rows = findings.explode_findings(found, ["document_id"])
    catalogue = findings.english_catalogue(spark).unionByName(spark.createDataFrame(
        [("hi", "findings.missing", None, "{field} नहीं है"), ("hi", "fields.khasra_number", None, "खसरा संख्या")],
        "locale string, key string, one string, other string"))
    assert findings.render_findings(rows, catalogue, "hi").first().rendered == "खसरा संख्या नहीं है"
    assert findings.render_findings(rows, catalogue, "en").first().rendered == "Khasra number is missing"


@pytest.mark.parametrize("name, said", [("confidence_checks", "Low confidence"), ("quality_deductions", "read with low confidence: ")])
def test_findings_are_worked_out_once(spark, name, said):
    from landledger import catalog

    catalog.load()
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    holding = [line for line in plan.toString().split("\n") if said in line]
    assert len(holding) == 1 and not holding[0].lstrip(" :+-").startswith("Filter")


def test_names_of_records_are_worked_out_once_for_all_joins(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(village):
        read.add(1)
        return village

    df = frame(spark, *[record(n, "VERIFIED" if n % 2 else "PENDING", khasra_number=str(n % 3)) for n in range(40)])
    assert validate.validate_records(df.withColumn("village", seen("village"))).count() == 40
    # Once for the keys; at most once more for the records that go out.
    assert read.value <= 80


def test_source_findings_are_not_worked_out_again_in_a_filter(spark):
    df = frame(spark, record(1, owner_name="अनिल वर्मा", khasra_number="1"), record(2, khasra_number="2"))
    sources = df.selectExpr(
        "'ROR' as source", "khasra_number", "village", "district", "if(document_id = 1, 'कमला देवी', owner_name) as owner_name",
        "khata_number", "plot_area", "land_classification", "timestamp'2026-01-01' as as_of",
    )
    found = reconcile.reconciliation_findings(df, sources, "2026-09-11")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "levenshtein" in line]) == 1
    assert [(r.document_id, [i.code for i in r.issues]) for r in found.collect()] == [(1, ["reconOwnerDiffers"])]


def test_few_spellings_are_met_in_many_tasks(spark, monkeypatch):
    # A small table of spellings lies in one task, which would compare all records sent to it.
    parts, join = [], validate.fuzzy_place_join
    monkeypatch.setattr(validate, "fuzzy_place_join", lambda a, b, *x: (parts.append(b.rdd.getNumPartitions()), join(a, b, *x))[1])
    rows = [record(i, "VERIFIED", owner_name=n) for i, n in enumerate(["राम लाल", "रमेश कुमार", "गोपाल"], 1)] + [record(9, owner_name="सीता देवी")]
    got = {r.document_id: r.conflict_with for r in validate.owner_conflicts(frame(spark, *rows)).collect()}
    assert min(parts) >= spark.sparkContext.defaultParallelism and got[9] == 1 and got[1] == 2
