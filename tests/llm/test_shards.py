from __future__ import annotations

import numpy as np

from landledger.llm.shards import read_from, slots, slots_of, write_shards
from tests.llm.fixtures import ODD, documents, prose
from tests.llm.test_packing import whole


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        to = slots(np.arange(n), n)
        assert sorted(to.tolist()) == list(range(n))
    assert slots(np.arange(1000), 1000).tolist() != slots(np.arange(1000), 1000, 5).tolist()
    assert abs(np.corrcoef(np.arange(4097), slots(np.arange(4097), 4097))[0, 1]) < 0.1


def test_shards(spark):
    texts = list(ODD) + [prose(i, 10 * i + 1) for i in range(120)]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 4"))
    shards = write_shards(docs, tokens=32, shard=64, row=16)
    rows = slots_of(shards, 32).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 64 for r in rows)
    where = {r.slot: (r.doc_id, r.piece) for r in rows}
    read = read_from(shards, 100, 32).collect()
    assert [r.slot for r in read] == list(range(100, len(rows)))
    for r in read:
        doc, piece = where[r.slot]
        assert np.frombuffer(r.ids, "<u2").tolist() == (whole(texts[doc]) + [1])[32 * piece:32 * piece + 32]
    assert sum(r.length for r in rows) == sum(len(whole(t)) + 1 for t in texts) + len(whole("one")) + 1
    assert slots_of(write_shards(docs.limit(0))).count() == 0


def test_resuming_in_long_rows(spark):
    docs = documents(spark, [prose(i, 4) for i in range(1500)])
    shards = write_shards(docs, tokens=32, shard=4096, row=1024)
    n = slots_of(shards, 32).count()
    assert [r.slot for r in read_from(shards, 700, 32).collect()] == list(range(700, n))
    assert read_from(shards.limit(0), 3, 32).count() == 0
