from __future__ import annotations

import re

from landledger.llm.decontaminate import benchmark_hits, drop_contaminated
from tests.llm.fixtures import ODD, documents, prose


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def by_hand(texts, items):
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for name, item in items:
            b = words(item)
            n = min(len(b), 10)
            windows = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= {str(name)} - {"None"}
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_hits(spark):
    items = [(i, prose(i, 8 + i)) for i in range(12)] + [(20, "Three short words"), (21, "solo"), (22, None), (23, "?!"), (2, prose(2, 10)), (24, "a b c d e"), (None, prose(300, 14)), (None, "nameless words")]
    texts = list(ODD)
    for i in range(12):
        w = prose(i, 8 + i).split()
        texts += [
            prose(50 + i, 20) + " " + " ".join(w[:10]).upper() + ", " + prose(70 + i, 5),
            " ".join(w[:9]) + " " + prose(90 + i, 20),
            " ".join(w) + " -- " + " ".join(w),
            " ".join(w[3:]) + " three; short-words solo",
            "a b c d e " * 5,
            f"{prose(400 + i, 5)} {prose(300, 14)} nameless words",
        ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in benchmark_hits(docs, bench).collect()}
    want = by_hand(texts, items)
    assert got == want
    clean = {r.doc_id for r in drop_contaminated(docs, bench).collect()}
    assert clean == {i for i, v in want.items() if not v[1]}


def test_none(spark):
    docs = documents(spark, [prose(1, 30), None])
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert [r.n_hit for r in benchmark_hits(docs, bench.limit(0)).collect()] == [0, 0]
    assert benchmark_hits(docs.limit(0), bench).count() == 0
    twice = benchmark_hits(docs.unionByName(docs), bench)
    assert sorted(r.n_hit for r in twice.collect()) == [0, 0, 30, 30]
    assert drop_contaminated(docs, bench).columns == docs.columns
