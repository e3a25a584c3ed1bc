from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from landledger.llm.syncmers import K, S, anchors, code_points, likeness, neighbour_fingerprints, spelled, spliced, whole_anchor
from landledger.llm import syncmers
from tests.llm.fixtures import ODD, documents, prose


def plain_anchors(text: str, k: int, s: int) -> list[int]:
    """Places of the closed syncmers, from hashes of single substrings."""
    def hashed(part):
        return int(syncmers._hashes(code_points(part), len(part))[0])

    out = []
    for i in range(len(text) - k + 1):
        inner = [hashed(text[j:j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


@pytest.mark.parametrize("k,s", [(K, S), (9, 3), (12, 11), (7, 1)])
def test_anchors_are_closed_syncmers(k, s, monkeypatch):
    monkeypatch.setattr(syncmers, "SLICE", 50)
    for text in [prose(1, 40), "aaaa" * 20, "naïve — ünïcode ΑΒΓ 😀 " * 5, "", "short"]:
        places, hashes = anchors(code_points(text), k, s)
        assert places.tolist() == plain_anchors(text, k, s)
        by_text = {}
        for p, h in zip(places.tolist(), hashes.tolist()):
            assert by_text.setdefault(text[p:p + k], h) == h
        # No run of 2 k - s code points is without an anchor.
        steps = np.diff(np.concatenate([[-1], places, [max(len(text) - k + 1, 0)]]))
        assert len(text) < 2 * k - s or steps.max() <= k - s + 1


def test_splices_have_the_anchors_of_the_whole():
    rng = random.Random(3)
    for _ in range(200):
        a, b = prose(rng.randrange(99), rng.randrange(30)), prose(rng.randrange(99), rng.randrange(30))
        a, b = code_points(a), code_points(b)
        cut, taken = rng.randint(0, len(a)), rng.randint(0, len(b))
        got = spliced(a[:cut], anchors(a), b[:taken], anchors(b))
        want = anchors(np.concatenate([a[:cut], b[:taken]]))
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_likeness():
    def of(text):
        return whole_anchor(code_points(text), anchors(code_points(text)))

    a, b = prose(1, 200), prose(2, 200)
    assert likeness(of(a), of(a)) == 1 and likeness(of(""), of("")) == 1 and likeness(of(""), of(a)) == 0
    assert likeness(of("ab"), of("ab")) == 1 and likeness(of("ab"), of("ac")) == 0
    assert likeness(of(a), of(b)) < 0.02
    half = of(a[:len(a) // 2] + b[:len(a) // 2])
    assert 0.4 < likeness(of(a), half) < 0.6
    assert likeness(of(a), half) == likeness(half, of(a))
    # The same passages the other way round match one of them only.
    assert 0.4 < likeness(of(a + "\n" + b), of(b + "\n" + a)) < 0.6
    assert spelled(of("")) == "" and len(spelled(of(a))) % 10 == 0


def by_hand(texts):
    out = []
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        taken = len(t) // 2
        edited = t[:len(t) - taken] + after[:taken]
        a, b, c = (whole_anchor(code_points(x), anchors(code_points(x))) for x in (t, after, edited))
        out.append((len(t), hashlib.sha256(edited.encode()).hexdigest(), spelled(a), spelled(c), likeness(a, c), likeness(a, b)))
    return out


@pytest.mark.parametrize("part_rows", [3, 2048])
def test_against_plain_python(spark, part_rows, monkeypatch):
    monkeypatch.setattr(syncmers, "PART_ROWS", part_rows)
    texts = [*ODD, *[prose(i % 9, 3 + 7 * i) for i in range(40)], "x" * 5000, prose(5, 20_000)]
    rows = neighbour_fingerprints(documents(spark, texts).repartition(5)).collect()
    assert [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)] == by_hand(texts)


def test_odd_rows(spark):
    docs = documents(spark, [prose(i, 30) for i in range(8)])
    assert neighbour_fingerprints(docs.limit(0)).count() == 0
    one = neighbour_fingerprints(docs.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].near_edited < 1
    none = docs.selectExpr("cast(null as long) doc_id", "text", "1 n_chars")
    both = neighbour_fingerprints(docs.withColumn("n_chars", docs.doc_id.cast("int")).select("doc_id", "text", "n_chars").unionByName(none)).collect()
    assert len(both) == 16 and sum(r.doc_id is None for r in both) == 8
    twice = neighbour_fingerprints(docs.unionByName(docs)).collect()
    assert len(twice) == 16 and sum(r.near_next == 1 for r in twice) == 8


def test_copies_of_one_id_fill_several_parts(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "PART_ROWS", 10)
    docs = spark.range(200).selectExpr("if(id < 150, 7, id) doc_id", "concat('text number ', id, repeat(' more words', 5)) text")
    rows, bounds = syncmers.in_order(docs, "doc_id", "text")
    parts = np.searchsorted(bounds, [r.key for r in rows.filter("doc_id = 7").collect()], "right")
    assert len(set(parts.tolist())) > 5
    assert neighbour_fingerprints(docs).count() == 200
