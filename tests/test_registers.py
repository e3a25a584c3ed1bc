"""Chain of title, orders, audit trail and limiter."""

from __future__ import annotations

import random
import tempfile
from datetime import date, datetime, timedelta
from fractions import Fraction

from pyspark.sql import functions as F

from landledger.catalog.chains import decided_orders
from landledger.functions import shares
from landledger.operators import audit, chain, limiter, orders, validate
from landledger.plans import evidence, views
from landledger.streaming.audit import stream_audit
from landledger.streaming.limiter import stream_limiter

SF = "/root/testdata/sf0.001"

NOW = "2026-09-11"
ENTRY = (
    "parcel_id bigint, id bigint, seq int, type string, from_owner string, to_owner string, share string, "
    "mutation_number string, effective_date date, supersedes_id bigint"
)


def entry(seq, kind, giver, taker, share, day, number=None, supersedes=None, parcel=1):
    return (parcel, parcel * 100 + seq, seq, kind, giver, taker, share, number, date.fromisoformat(day), supersedes)


def replayed(spark, *rows):
    standing = chain.standing_entries(spark.createDataFrame(list(rows), ENTRY))
    return standing, chain.chain_replay(standing)


def codes(spark, *rows):
    standing, replay = replayed(spark, *rows)
    found = chain.chain_findings(standing, NOW, replay).orderBy("parcel_id", "phase", "ord").collect()
    return [(r.code, r.seq) for r in found]


FIRST = entry(1, "ORIGINAL", None, "राम प्रसाद", "1", "1990-01-01")


def test_clean_chain(spark):
    standing, replay = replayed(spark, FIRST, entry(2, "SALE", "राम प्रसाद", "श्याम लाल", "1/2", "2000-01-01"))
    assert chain.chain_findings(standing, NOW, replay).count() == 0
    held = [(r.owner, r.share) for r in chain.holders_current(replay).orderBy("place").collect()]
    assert held == [("राम प्रसाद", "1/2"), ("श्याम लाल", "1/2")]
    assert chain.chain_span(standing).first().years == 10.0


def test_each_defect(spark):
    sold = entry(2, "SALE", "राम प्रसाद", "श्याम लाल", "1", "2000-01-01")
    assert codes(spark, FIRST, sold, entry(3, "SALE", "राम प्रसाद", "मोहन", "1", "2001-01-01")) == [("doubleSale", 3)]
    assert codes(spark, FIRST, entry(2, "SALE", "कोई और", "मोहन", "1", "2001-01-01")) == [("chainBreak", 2)]
    died = entry(2, "INHERITANCE", "राम प्रसाद", "सीता", "1", "2000-01-01")
    assert codes(spark, FIRST, died, entry(3, "SALE", "राम प्रसाद", "मोहन", "1", "2001-01-01")) == [("deceasedTransferor", 3)]
    assert codes(spark, FIRST, entry(2, "SALE", "राम प्रसाद", "मोहन", "3/2", "2001-01-01")) == [("overTransfer", 2)]
    assert codes(spark, FIRST, entry(2, "SALE", None, "मोहन", "1", "2001-01-01")) == [("missingTransferor", 2)]
    assert codes(spark, FIRST, entry(2, "SALE", "राम प्रसाद", "मोहन", "आधा", "2001-01-01")) == [("unreadableShare", 2)]
    assert codes(spark, entry(1, "SALE", "राम", "मोहन", "1", "2001-01-01")) == [("titleNotTraced", 1)]
    assert codes(spark, FIRST, entry(2, "ORIGINAL", None, "मोहन", "1/2", "2001-01-01")) == [("sharesExceedWholeTotal", None)]
    assert codes(spark, FIRST, entry(2, "SALE", "राम प्रसाद", "मोहन", "1", "2030-01-01", "5"), entry(3, "SALE", "मोहन", "गीता", "1", "2031-01-01", "5")) == [
        ("futureDated", 2), ("futureDated", 3), ("duplicateNumber", 3)]


def test_heirs_are_settled_together(spark):
    heirs = [entry(n, "INHERITANCE", "राम प्रसाद", f"वारिस {n}", share, "2000-01-01") for n, share in ((2, "1/2"), (3, "1/3"), (4, "1/3"))]
    assert codes(spark, FIRST, *heirs) == [("sharesExceedWhole", 2)]
    assert codes(spark, FIRST, *heirs[:2]) == [("undistributed", 2)]
    _, replay = replayed(spark, FIRST, *heirs)
    assert sum(Fraction(r.share) for r in chain.holders_current(replay).collect()) == Fraction(7, 6)


def test_correction_takes_the_place_it_restates(spark):
    rows = [FIRST, entry(2, "SALE", "राम प्रसाद", "मोहन", "1/2", "2000-01-01"), entry(3, "SALE", "मोहन", "गीता", "1/2", "2005-01-01"),
            entry(4, "SALE", "राम प्रसाद", "मोहन", "1", "2000-01-01", supersedes=102), entry(5, "SALE", "राम प्रसाद", "मोहन", "1", "2000-02-01", supersedes=104)]
    standing, replay = replayed(spark, *rows)
    assert sorted((r.id, r.seq) for r in standing.collect()) == [(101, 1), (103, 3), (105, 2)]
    assert chain.chain_findings(standing, NOW, replay).count() == 0
    ring = [entry(1, "SALE", "a", "b", "1", "2000-01-01", supersedes=102), entry(2, "SALE", "a", "b", "1", "2000-01-01", supersedes=101)]
    assert chain.standing_entries(spark.createDataFrame(ring, ENTRY)).count() == 0


def walked(rows):
    """Places by a walk from every correction, one link at a time."""
    by_id = {(r[0], r[1]): r for r in rows}
    out = {}
    for r in rows:
        if r[9] is None:
            continue
        place, cursor, seen = r[2], by_id.get((r[0], r[9])), set()
        while cursor and cursor[1] not in seen:
            seen.add(cursor[1])
            place = cursor[2]
            cursor = by_id.get((r[0], cursor[9]))
        out[r[0], r[1]] = place
    return out


def test_correction_places_in_few_rounds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(1, n, n, "SALE", "a", "b", "1", None, date(2000, 1, 1), n - 1 if n > 1 else None) for n in range(1, 1002)]
    # Lines that cross, end at an entry that is not there, and run into rings of one, two and five.
    for parcel in range(2, 40):
        n = rng.randrange(1, 30)
        rows += [(parcel, k, 100 - k, "SALE", "a", "b", "1", None, date(2000, 1, 1), rng.choice([None, k - 1, rng.randrange(n + 3), rng.randrange(n)])) for k in range(n)]
    rows += [(50, k, k, "SALE", "a", "b", "1", None, date(2000, 1, 1), to) for k, to in enumerate([0, 2, 1, 1, 3, 4, 7, 8, 9, 10, 6, 6, 11, None, 99])]
    rounds = []
    plain = chain.settle
    monkeypatch.setattr(chain, "settle", lambda df: rounds.append(1) or plain(df))
    lines = spark.createDataFrame([r for r in rows if r[0] == 1], ENTRY)
    got = {(r.parcel_id, r.id): r.position for r in chain.correction_position(lines).collect()}
    assert got == walked([r for r in rows if r[0] == 1]) and len(rounds) <= 12
    got = {(r.parcel_id, r.id): r.position for r in chain.correction_position(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == walked(rows)
    assert chain.correction_position(lines.limit(0)).count() == 0


def test_backdating_over_a_long_register(spark):
    rng = random.Random(5)
    rows = [(1, n, n, "ORIGINAL", None, "x", "0", None, date(1990, 1, 1) + timedelta(days=rng.randint(0, 4000)), None) for n in range(1, 9001)]
    df = spark.createDataFrame(rows, ENTRY)
    got = {(r.seq, r.params["prevSeq"]) for r in chain.backdated(df).collect()}
    want, latest = set(), None
    for r in rows:
        if latest and r[8] < latest[8]:
            want.add((r[2], str(latest[2])))
        if latest is None or r[8] > latest[8]:
            latest = r
    assert got == want


def test_owner_against_chain(spark):
    standing, replay = replayed(spark, FIRST, entry(2, "SALE", "राम प्रसाद", "श्याम लाल", "1/3", "2000-01-01"))
    owners = spark.createDataFrame([(7, 1, "श्री राम प्रसाद"), (8, 1, "मोहन"), (9, 1, None)], "document_id bigint, parcel_id bigint, owner_name string")
    got = {r.document_id: r.issues[0] for r in chain.owner_vs_chain(owners, replay).collect()}
    assert set(got) == {7, 8} and got[8].code == "unrecordedTransfer" and got[7].params["others"] == "श्याम लाल (1/3)"
    assert got[8].params["head"] == "राम प्रसाद (2/3), श्याम लाल (1/3)"


def test_share_forms(spark):
    texts = ["1", "1/2", " 2 / 4 ", "0.25", "½", "⅔", "आधा", "1/0", "", None, "1.50", "0.333333333333333333", "0.25000000000000000000000", "4660046610375530309/7540113804746346429"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r.f is None else (r.f.n, r.f.d) for r in df.selectExpr(f"{shares.parse_share('t')} as f").collect()]
    assert got == [shares.read_share(t) for t in texts] and shares.read_share("½") == (1, 2)
    words = spark.createDataFrame([("सम्पूर्ण",), ("समपूरण",), ("Whole",), ("4/8",), ("कुछ",)], "t string")
    assert [r[0] for r in words.selectExpr(shares.normalised_share("t")).collect()] == ["1", "1", "1", "1/2", None]


def test_order_preview_reports_what_an_order_adds(spark):
    parcels = spark.createDataFrame([(1, "142/3", "मलिहाबाद", "लखनऊ")], "parcel_id bigint, khasra_number string, village string, district string")
    register = spark.createDataFrame([FIRST, entry(2, "SALE", "कोई और", "x y", "1", "1999-01-01"), entry(3, "SALE", "राम प्रसाद", "श्याम लाल", "1", "2000-01-01")], ENTRY)
    columns = "document_id bigint, mutation_number string, order_date string, mutation_type string, from_owner string, to_owner string, share string, deed_number string, khasra_number string, village string, district string, confidence map<string,double>"
    rows = [
        (11, "5/2025", "01/02/2025", "विक्रय", "राम प्रसाद", "मोहन", "सम्पूर्ण", None, "142/3", "मलहिबाद", "लखनऊ", {}),
        (12, "6/2025", "31/02/2025", "बैनामा", "श्याम लाल", "मोहन", "1/2", None, "142/3", "मलिहाबाद", "लखनऊ", {"share": 0.5}),
        (13, "7/2025", "1.2.2025", "sale", "श्याम लाल", "मोहन", "1/2", None, "142/3", "मलिहाबाद", "लखनऊ", {}),
    ]
    got = {r.document_id: r for r in orders.order_preview(spark.createDataFrame(rows, columns), parcels, register, NOW).collect()}
    assert got[11].introduced == ["doubleSale"] and [i.kind for i in got[11].issues] == ["chainDefect"]
    assert [i.code for i in got[12].issues] == ["orderBadDate", "orderLowConfidence"] and not got[12].is_candidate
    assert got[13].order_status == "PASS" and got[13].issues == []


def trail(spark, n=200, documents=5):
    start = datetime(2026, 1, 1)
    rows = [(i % documents, i, f"u{i % 3}", "EDIT", None, f'{{"b": {i}, "a": "x\\"y"}}', start + timedelta(milliseconds=37 * i)) for i in range(n)]
    return spark.createDataFrame(rows, "document_id bigint, entry_id bigint, actor_id string, action string, before string, after string, timestamp timestamp")


def test_every_kind_of_tampering_is_found(spark):
    stored = audit.audit_append(trail(spark)).persist()

    def verdict(df):
        r = audit.audit_verify(df).filter("document_id = 1").first()
        return r.intact, r.broken_at, r.reason

    assert audit.audit_verify(stored).filter("not intact").count() == 0
    assert verdict(stored.withColumn("after", F.expr("if(document_id = 1 and seq = 3, '{}', after)"))) == (False, 3, "altered")
    assert verdict(stored.filter("not (document_id = 1 and seq = 3)")) == (False, 4, "unlinked")
    assert verdict(stored.withColumn("hash", F.expr("if(document_id = 1 and seq = 3, null, hash)"))) == (False, 3, "unhashed")
    # Texts that are not JSON count as they are.
    loose = audit.audit_append(trail(spark).withColumn("after", F.lit("{not json"))).persist()
    assert verdict(loose) == (True, None, None)
    assert verdict(loose.withColumn("after", F.expr("if(document_id = 1 and seq = 3, '{not jsan', after)"))) == (False, 3, "altered")
    # Only the order of keys and spaces differs, so the hash is the same.
    assert verdict(stored.withColumn("after", F.expr("to_json(parse_json(after))"))) == (True, None, None)


def test_appending_in_two_batches_is_one_chain(spark):
    entries = trail(spark)
    whole = {tuple(r) for r in audit.audit_append(entries).select("entry_id", "seq", "hash", "prev_hash").collect()}
    first = audit.audit_append(entries.filter("entry_id < 90"))
    second = audit.audit_append(entries.filter("entry_id >= 90"), audit.trail_heads(first))
    both = first.unionByName(second).select("entry_id", "seq", "hash", "prev_hash")
    assert {tuple(r) for r in both.collect()} == whole


def requests(spark, n=400):
    rng, at = random.Random(2), datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        at += timedelta(milliseconds=rng.choice([0, 5, 300, 2000]))
        rows.append(("hot" if i % 3 else f"c{i % 7}", i, at))
    return spark.createDataFrame(rows, "caller string, request_id bigint, at timestamp")


def test_limiter_against_plain_loop(spark):
    asked = requests(spark)
    got = {r.request_id: r.allowed for r in limiter.request_limiter(asked.repartition(7), 3, 5000).collect()}
    windows: dict = {}
    for r in asked.selectExpr("caller", "request_id", "unix_millis(at) as t").orderBy("t", "request_id").collect():
        start, count = windows.get(r.caller, (None, 0))
        if start is None or r.t - start >= 5000:
            windows[r.caller], allowed = (r.t, 1), True
        elif count < 3:
            windows[r.caller], allowed = (start, count + 1), True
        else:
            allowed = False
        assert got[r.request_id] == allowed


def test_limiter_of_a_hot_caller_in_blocks(spark):
    rng = random.Random(8)
    for window, steps in ((5000, [0, 5, 300, 2000]), (40, [0, 0, 1, 2, 90]), (10**6, [1, 7]), (1, [0, 1, 3])):
        at, rows = 0, []
        for i in range(1500):
            at += rng.choice(steps)
            rows.append((rng.choice(["hot", "hot", "warm", "warm", None, f"c{i % 9}"]), i // 2 if i % 5 else i, None if i % 97 == 0 else at))
        asked = spark.createDataFrame(rows, "caller string, request_id bigint, t bigint").selectExpr(
            "caller", "request_id", "timestamp_millis(t) as at")
        whole = limiter.request_limiter(asked, 3, window).collect()
        split = limiter.request_limiter(asked.repartition(5), 3, window, block=40).collect()
        assert sum(r.allowed for r in whole) not in (0, len(rows))
        key = lambda r: (r.caller or "", r.at_ms or -1, r.request_id, r.allowed)
        assert sorted(split, key=key) == sorted(whole, key=key)
    none = asked.limit(0)
    assert limiter.request_limiter(none, 3, 5000).count() == 0


def test_streams_equal_their_batch_forms(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    entries = trail(spark)
    for n in range(3):
        entries.filter(f"entry_id div 67 = {n}").coalesce(1).write.parquet(f"{folder}/in/part={n}")
    source = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")

    def drained(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return {tuple(r) for r in spark.table(name).collect()}

    batch = audit.audit_append(entries).select("document_id", "entry_id", "seq", "hash", "prev_hash")
    assert drained(stream_audit(source), "audit_out") == {tuple(r) for r in batch.collect()}
    # Ids fall as time goes on, and the last file brings entries of the first once more.
    falling = entries.withColumn("entry_id", F.expr("1000 - entry_id"))
    for n, part in enumerate((falling.filter("entry_id > 900"), falling.filter("entry_id <= 900"), falling.filter("entry_id > 950"))):
        part.coalesce(1).write.parquet(f"{folder}/falling/part={n}")
    again = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/falling/*")
    batch = audit.audit_append(falling).select("document_id", "entry_id", "seq", "hash", "prev_hash")
    assert drained(stream_audit(again), "falling_out") == {tuple(r) for r in batch.collect()}
    def asked(df):
        return df.selectExpr("cast(document_id as string) as caller", "timestamp as at", "entry_id as request_id")

    allowed = limiter.request_limiter(asked(entries), 3, 500).select("caller", "request_id", "at_ms", "allowed")
    assert drained(stream_limiter(asked(source), 3, 500), "limit_out") == {tuple(r) for r in allowed.collect()}


def test_wide_shares(spark):
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"0.{digits(30)}" for _ in range(40)] + [f"{digits(n)}/{digits(n - 1)}7" for n in range(2, 38)] + [
        "0." + "3" * 37, "0.5" + "0" * 60, "9" * 38 + "/3", "9" * 38 + "/7", "0/5", "5/0", str(6 * 10**36) + "/" + str(4 * 10**36),
    ]
    pairs = spark.createDataFrame([(t, rng.choice(texts[:40])) for t in texts], "t string, u string").selectExpr(
        "t", "u", f"{shares.parse_share('t')} as x", f"{shares.parse_share('u')} as y")
    rows = pairs.selectExpr(
        "t", "u", "x", f"{shares.share_sum('x', 'y')} as more", f"{shares.share_difference('x', 'y')} as less", f"{shares.share_sign('x', 'y')} as sign"
    ).collect()
    exact = 0
    for r in rows:
        want = shares.read_share(r.t)
        assert (None if r.x is None else (int(r.x.n), int(r.x.d))) == want, r.t
        if want:
            a, b = Fraction(*want), Fraction(*shares.read_share(r.u))
            for got, value in ((r.more, a + b), (r.less, a - b)):
                assert got is None or Fraction(int(got.n), int(got.d)) == value
                exact += got is not None
            assert r.sign in (None, (a > b) - (a < b))
    assert exact > 80


def test_numbers_in_canonical_json(spark):
    import json

    cases = {
        "1e5": "100000", "1.0": "1", "1E-7": "1e-7", "-0": "0", "-0.0": "0", "0.000001": "0.000001", "1.50": "1.5", "-12.25e1": "-122.5",
        "1e21": "1e+21", "123456789012345678901": "123456789012345680000", "1e300": "1e+300", "0.1": "0.1", "100": "100", "12e-8": "1.2e-7",
    }
    frame = spark.createDataFrame([(k, json.dumps({"b": [1, "x 1e5 \\\" 2.0", {"z": None}], "a": 0}).replace("0}", k + "}")) for k in cases], "k string, j string")
    for r in frame.selectExpr("k", f"{audit.canonical_json('j')} as c").collect():
        assert r.c == '{"a":' + cases[r.k] + ',"b":[1,"x 1e5 \\\\\\" 2.0",{"z":null}]}'
    long = json.dumps({"a": "\"\\" * 20000, "n": 1.0}).replace(" ", "")
    assert spark.createDataFrame([(long,)], "j string").selectExpr(f"{audit.canonical_json('j')} as c").first().c == long.replace("1.0", "1")
    assert spark.sql("select '{x' as j").selectExpr(f"{audit.canonical_json('j')} as c").first().c is None


def test_an_id_twice_in_a_register(spark):
    twice = [entry(3, "SALE", "राम", taker, "1", "2001-01-01", "M-3") for taker in ("मोहन", "सोहन")]
    rows = [FIRST, *twice, entry(4, "SALE", "राम", "गीता", "1", "2002-01-01", "M-4", supersedes=103)]
    positions = chain.correction_position(spark.createDataFrame(rows, ENTRY)).collect()
    assert [(r.id, r.position) for r in positions] == [(104, 3)]
    assert sorted(r.id for r in chain.standing_entries(spark.createDataFrame(rows, ENTRY)).collect()) == [101, 104]


def test_first_number_twice_at_one_place(spark):
    twice = [entry(2, "SALE", "राम", taker, "1", "2001-01-01", "M-2") for taker in ("मोहन", "सोहन", "गीता")]
    standing = chain.standing_entries(spark.createDataFrame([FIRST, *twice, entry(5, "SALE", "राम", "सीता", "1", "2002-01-01", "M-2")], ENTRY))
    found = chain.duplicate_numbers(standing).collect()
    assert sorted((r.seq, r.params["first"]) for r in found) == [(2, "2"), (2, "2"), (5, "2")]


def test_a_register_is_worked_out_once(spark):
    mutations = views.mutations(spark, SF)
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    n, seen = mutations.count(), mutations.mapInArrow(counted, mutations.schema)
    chain.standing_entries(seen).count()
    assert asked.value == n
    rescored = evidence.rescore_parcels(
        validate.validate_records(views.records(spark, SF)), views.sources(spark, SF), views.parcels(spark, SF), seen,
        views.order_readings(spark, SF), decided_orders(spark, SF), views.NOW,
    )
    assert rescored.count() > 0 and asked.value == 2 * n


def test_holders_keys_are_spelled_out_once(spark):
    holders = "array<struct<owner:string,share:string,since:date>>"
    replay = spark.createDataFrame(
        [(1, "end", [("Shri Ram Lal", "1/2", None), ("Sita", "1/2", None)]), (2, "end", [("Mohan", "1", None)]), (3, "finding", None)],
        f"parcel_id long, row_kind string, holders {holders}",
    )
    owners = spark.createDataFrame([(10, 1, "ram lal"), (11, 1, "gopal"), (12, 2, "mohan"), (13, 3, "x")], "document_id long, parcel_id long, owner_name string")
    found = chain.owner_vs_chain(owners, replay)
    # Once for owners and once for holders.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert {r.document_id: r.issues[0].code for r in found.collect()} == {10: "unlistedCoOwners", 11: "unrecordedTransfer"}


def test_wide_evidence_is_kept_in_tables(spark, monkeypatch):
    # Checkpoints are not compressed and are read whole; only ids go there.
    sf_dir, kept, settle = "/root/testdata/sf0.001", [], evidence.settle
    monkeypatch.setattr(evidence, "settle", lambda df: (kept.append(df.columns), settle(df))[1])
    found = evidence.Evidence(views.records(spark, sf_dir), views.sources(spark, sf_dir), views.parcels(spark, sf_dir), views.mutations(spark, sf_dir), views.NOW)
    assert kept == [["document_id", "parcel_id"]]
    assert found.replay.filter("row_kind = 'end'").count() == found.standing.select("parcel_id").distinct().count() > 0
