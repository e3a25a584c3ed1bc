from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from landledger.llm.packing import Encoder, best_two_fit, packed_documents, sequences
from tests.llm.fixtures import ODD, documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


WHOLE = Tokenizer.from_file(PATH)


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_encoder_cuts_nothing_apart():
    encode, rng = Encoder(PATH), random.Random(3)
    alphabet = list("abcXYZ019'.,!  \n\n\t\x0b\x1c\xa0̈́éßΣς中国🙂\x01") + ["'s", "'LL ", " ̈", "\r\n", "x" * 80, "a. ", "b.,", "'s.\n", ". .", "<|ENDOFTEXT|>", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + [x for x in ODD if x]
    letters = "abcdefgàçéñöüßÿøþ÷×ÀÉÖ"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for t in texts + texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole(t), repr(t)


def test_plan_places_every_piece():
    rng = random.Random(5)
    for capacity, n in ((64, 500), (64, 3), (4096, 3000), (10, 4000)):
        counts = {}
        for _ in range(n):
            k = min(capacity, 1 + int(rng.expovariate(5 / capacity)))
            counts[k] = counts.get(k, 0) + 1
        plan, seen = best_two_fit(counts, capacity), {}
        for bins, used in plan:
            assert bins > 0 and sum(k * c for k, c in used) <= capacity
            for k, c in used:
                seen[k] = seen.get(k, 0) + bins * c
        assert seen == counts
        least = -(-sum(k * c for k, c in counts.items()) // capacity)
        assert sum(b for b, _ in plan) <= 1.02 * least + 1
    # Greedy would put 6 and 3 together; 6 and the pair 2 + 2 fill the bin.
    assert (1, [(6, 1), (2, 2)]) in best_two_fit({6: 1, 3: 1, 2: 2}, 10)


def test_documents(spark):
    texts = list(ODD) + [prose(i, 5 + 13 * i) for i in range(60)] + [prose(1, 3000)]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    packed = packed_documents(docs, capacity=200)
    rows = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    filled = {r.sequence_id: list(r.ids) for r in sequences(docs, packed, capacity=200).collect()}
    assert filled.keys() == by_sequence.keys()
    for key, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 200 and len(filled[key]) == at
    for i, t in enumerate(texts):
        ids = whole(t) + [1]
        for r in by_doc[i]:
            part = ids[r.start:r.start + r.length]
            assert r.length == min(200, len(ids) - r.start) and r.start == 200 * r.piece
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert filled[r.sequence_id][r.offset:r.offset + r.length] == part
        assert sum(r.length for r in by_doc[i]) == len(ids) * (1 + (i < 3))
    assert packed_documents(docs.limit(0)).count() == 0


def test_words_of_latin_letters_are_cut_without_the_whole_tokenizer():
    encode = Encoder(PATH)
    texts = ["Élan n'était qu'un «mot»", "a1b22--'re 3fdf,5a.x\tÀ\x1cÿ", "don't ''s x's É's ẞ K", "\x00\x7f é!? ...\n.,"]
    right = [whole(t) for t in texts]
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == right
    encode.clear()
    encode.tokenizer = None
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts[1:]] == right[1:]
