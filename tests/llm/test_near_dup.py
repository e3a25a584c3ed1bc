from __future__ import annotations

import random
import re

from landledger.llm import near_dup
from landledger.llm.near_dup import near_duplicates
from tests.llm.fixtures import ODD, documents, prose


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def by_hand(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}


def changed(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def texts_of_all_kinds():
    rng = random.Random(11)
    texts = list(ODD) + ["a b c", "A  b\nc", "a b c d"]
    for size, copies, changes in ((30, 6, 1), (120, 30, 5), (300, 90, 16), (900, 40, 45), (60, 40, 3)):
        base = prose(size, size)
        texts += [changed(base, rng.randrange(changes + 2), rng) for _ in range(copies)]
    passage = prose(7, 70)
    texts += [passage + " " + prose(1000 + i, 30 + i % 40) for i in range(60)]
    rng.shuffle(texts)
    return texts


def test_links(spark):
    texts = texts_of_all_kinds()
    want = by_hand(texts)
    assert 20 < sum(not v[2] for v in want.values())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == want


def test_blocks_of_a_large_star(spark, monkeypatch):
    texts = texts_of_all_kinds()
    plain = near_dup.in_cells
    monkeypatch.setattr(near_dup, "in_cells", lambda *a: plain(*a[:5], block=7))
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: v[1] for i, v in by_hand(texts).items()}


def test_odd_rows(spark):
    docs = documents(spark, [prose(1, 40), prose(2, 40), prose(1, 40) + " end", None])
    rows = near_duplicates(docs.unionByName(docs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 0), (2, 0), (3, 3), (3, 3)]
    assert near_duplicates(docs.limit(0)).count() == 0
    unnamed = docs.selectExpr("cast(null as long) doc_id", "text")
    assert {(r.component_id, r.kept) for r in near_duplicates(unnamed).collect()} == {(None, True)}
    text = prose(9, 60)
    twice = spark.createDataFrame([(0, text), (1, text + " end"), (1, None), (2, "!"), (2, text + " stop"), (2, "")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(twice).collect() if r.n_shingles > 10} == {(0, 0), (1, 0), (2, 0)}
