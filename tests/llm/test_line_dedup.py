from __future__ import annotations

import hashlib

from landledger.llm.line_dedup import BLANKS, drop_repeated_lines
from landledger.llm.shared import UPPER
from tests.llm.fixtures import ODD, documents, prose


def by_hand(texts):
    def key(line):
        return line.strip(BLANKS).translate(str.maketrans(UPPER, UPPER.lower()))

    holders = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or i == max(holders[key(x)])]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_lines(spark):
    common = prose(1, 12)
    texts = list(ODD)
    for i in range(40):
        middle = ["  " + common.upper() + "\t", common][i % 2]
        texts.append("\n".join([prose(100 + i, 9), middle, "short", middle if i % 3 else "", prose(i % 9, 8)]))
    got = {
        r.doc_id: (r.text, r.n_lines, r.n_dropped)
        for r in drop_repeated_lines(documents(spark, texts)).collect()
    }
    assert got == by_hand(texts)
    assert sum(v[2] for v in got.values()) > 50


def test_repeated_rows_extra_columns_and_none(spark):
    docs = documents(spark, [prose(1, 12)] * 4)
    df = drop_repeated_lines(docs.unionByName(docs).withColumn("n_lines", docs.doc_id))
    assert df.columns == ["doc_id", "text", "lang", "source", "row", "kept", "n_lines", "n_dropped"]
    assert df.filter("n_dropped > 0").count() == 0
    assert df.count() == 8
    assert drop_repeated_lines(docs.limit(0)).count() == 0
    none = docs.selectExpr("cast(null as long) doc_id", "text").unionByName(documents(spark, [prose(1, 12)] * 6).select("doc_id", "text"))
    assert [r.doc_id for r in drop_repeated_lines(none).collect() if not r.n_dropped] == [5]
