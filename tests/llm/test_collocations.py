from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from landledger.llm import collocations as module
from landledger.llm.collocations import MOST_WORDS, Phrases, Summary, blocks, collocations, frequent_phrases
from landledger.llm.shared import UPPER
from tests.llm.fixtures import ODD, WORDS, documents

LOWER = str.maketrans(UPPER, UPPER.lower())


def counted(rows):
    found, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, MOST_WORDS + 1):
                for i in range(len(w) - k + 1):
                    found[lang or "und", " ".join(w[i:i + k])] += 1
    return found, total


def by_hand(rows, least=10, top=2000, shortest=2, held=50):
    found, total = counted(rows)
    wanted = {(lang, p): a for (lang, p), a in found.items() if a >= least and shortest <= p.count(" ") + 1}
    out = {}
    for (lang, p), a in wanted.items():
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = found[lang, " ".join(w[:k])], found[lang, " ".join(w[k:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        out[lang, p] = (a, *min(cuts))
    for (lang, p), a in wanted.items():
        w = p.split(" ")
        for k in range(shortest, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, " ".join(w[i:i + k]))
                if part in out and 100 * a >= held * out[part][0]:
                    del out[part]
    result = []
    for lang in {x for x, _ in out}:
        best = sorted(((-s, -a, p.encode(), p, a, l, r) for (of, p), (a, s, _, l, r) in out.items() if of == lang))[:top]
        result += [(lang, i + 1, p, a, l, r, total[lang], -s) for i, (s, _, _, p, a, l, r) in enumerate(best)]
    return sorted(result)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [*WORDS[:9], "É", "naïve", "x\x1cy", "a\xa0b", "\x85", "Ünï", "A", "B-b"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b", " New  York "]) for _ in range(rng.randrange(120)))
        rows.append((["en", "de", None][i % 3], text))
    return rows + [("en", t) for t in ODD]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 0, 0) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase int")


@pytest.mark.parametrize("block,held,most", [(4 << 20, 4_000_000, 4_000_000), (300, 50, 20)])
def test_against_plain_python(spark, monkeypatch, block, held, most):
    for name, value in {"BLOCK": block, "HELD": held, "DISTINCT": most}.items():
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(blocks, "__defaults__", (block,))
    rows = corpus()
    docs = frame(spark, rows).repartition(3)
    assert sorted(map(tuple, collocations(docs).collect())) == by_hand(rows)
    assert sorted(map(tuple, collocations(docs, least=4, top=7, held_percent=80).collect())) == by_hand(rows, 4, 7, held=80)
    found, _ = counted(rows)
    got = {(r.lang, r.phrase): r.n for r in frequent_phrases(docs, least=3).collect()}
    assert got == {k: v for k, v in found.items() if v >= 3}


def test_long_texts_are_cut_without_loss(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice(WORDS[:5]) + rng.choice(["", ".", ""]) for _ in range(3000)) + " " + "z" * 900
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    want, _ = counted([("en", text)])
    got, powers = Counter(), [np.empty(0, "uint64")] * 2
    parts = list(blocks(batch, 3, 100))
    assert len(parts) > 100
    long = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(["w" * 60, "v" * 70] * 9)])], ["lang", "text"])
    assert 1 < len(list(blocks(long, 3, 100))) < 20
    for _, raw, skip in parts:
        found = Phrases(raw, skip, powers)
        for size in range(1, 4):
            for i in found.begins(size):
                got["en", " ".join(raw[a:b].decode() for a, b in zip(found.starts[i:i + size], found.ends[i:i + size]))] += 1
    assert got == want


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(2)
    for least in (3, 10, 50):
        values = np.concatenate([rng.zipf(1.3, 20_000) % 5000, np.repeat(np.arange(6000, 6050), least)]).astype("uint64")
        rng.shuffle(values)
        own = Summary(len(values) // least + 1)
        # Parts are summaries themselves, dumped, loaded and merged in any order.
        for part in np.array_split(values, 13):
            of_part = Summary(len(part) // least + 1)
            of_part.add(*np.unique(part, return_counts=True))
            of_part.merge()
            own.add(*Summary.load(of_part.dump()))
            own.error += of_part.error
        own.merge()
        keys, counts = np.unique(values, return_counts=True)
        exact = dict(zip(keys.tolist(), counts.tolist()))
        assert len(own.keys) <= own.capacity
        for k, c in zip(own.keys.tolist(), own.counts.tolist()):
            assert c <= exact[k] <= c + own.error
        single = Summary(len(values) // least + 1)
        for part in np.array_split(values, 13):
            single.add(*np.unique(part, return_counts=True))
            single.merge()
        assert single.error < least
        assert set(keys[counts >= least].tolist()) <= set(single.survivors(least).tolist())


def test_large_counts_are_exact(spark):
    # Products beyond 64 bits: a = l = r = 4 * 10^9 would need 10^6 * 1.6 * 10^19.
    score = "(1000000 * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
    row = spark.sql("select 4000000000L a, 4000000001L l, 4000000003L r").selectExpr(f"{score} as s").first()
    assert row.s == 10**6 * (4 * 10**9) ** 2 // ((4 * 10**9 + 1) * (4 * 10**9 + 3))
    row = spark.sql("select 9000000000000000L a, 9000000000000000L l, 9000000000000000L r").selectExpr(f"{score} as s").first()
    assert row.s == 10**6


def test_odd_rows(spark):
    docs = frame(spark, [("en", None), ("en", ""), (None, " . ")])
    assert collocations(docs).count() == 0 and collocations(docs.limit(0)).count() == 0
    assert collocations(frame(spark, [("en", "a b")] * 10)).collect()[0].a == 10
    assert collocations(frame(spark, [("en", "a b")] * 9)).count() == 0
    # A tie of score and count is broken by the bytes of the phrase.
    rows = [("en", "é f. z y. B c")] * 12
    assert [r.phrase for r in collocations(frame(spark, rows)).orderBy("rank").collect()] == ["b c", "z y", "é f"]
