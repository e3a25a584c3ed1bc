from __future__ import annotations

import hashlib

import regex

from landledger.llm.infill import fill_in_middle, restored
from tests.llm.fixtures import ODD, documents, prose

MARKED = ["has <P> in it", "<S>", "x<M>y", "<P", "S>", "<<P", "P>M>"]


def by_hand(doc_id, t, unit=None):
    units = regex.findall(unit, t) if unit else list(t)
    n = len(units)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_plain_python_and_back(spark):
    texts = [*ODD, *MARKED, *[prose(i, 1 + 3 * i) for i in range(120)], "\n\r\n\x00\x85\u2028" * 9, "😀é́\n" * 9, "ab\n" * 100_000, "Q:\\E.*"]
    made = fill_in_middle(documents(spark, texts)).withColumn("again", restored())
    assert made.columns == ["doc_id", "text", "lang", "source", "row", "kept", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    rows = made.collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert tuple(r)[6:11] == by_hand(r.doc_id, t)
        assert r.again == t
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_units_of_several_code_points(spark):
    texts = ["e\u0301a\r\n👍🏽b" * 5, None, "abc"]
    for r in fill_in_middle(documents(spark, texts), unit=r"\X").withColumn("again", restored()).collect():
        assert tuple(r)[6:11] == by_hand(r.doc_id, texts[r.doc_id] or "", r"\X")
        assert r.again == (texts[r.doc_id] or "")
    # A text that units do not fill is left as it is.
    left = fill_in_middle(documents(spark, ["abc", "ab1"]), unit="[a-z]", transformed=100).collect()
    assert [(r.n, r.form == "plain") for r in left] == [(3, False), (None, True)]


def test_odd_rows(spark):
    docs = documents(spark, [prose(i, 30) for i in range(8)])
    assert fill_in_middle(docs.limit(0)).count() == 0
    clash = docs.withColumns({"n": docs.doc_id, "form": docs.text, "_h0": docs.doc_id})
    rows = fill_in_middle(clash.unionByName(clash)).collect()
    assert len(rows) == 16 and len({(r.doc_id, r.output, r._h0) for r in rows}) == 8
    none = docs.selectExpr("cast(null as long) doc_id", "text")
    assert len({(r.n, r.text) for r in fill_in_middle(none).withColumn("again", restored()).filter("again = text").collect()}) == 8
