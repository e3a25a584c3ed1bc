from __future__ import annotations

import random
from collections import Counter

from landledger.llm.rules import clean_lines, judge_lines, line_fails, repeated_words
from tests.llm.fixtures import ODD, documents, prose


def test_repeated_words():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randrange(40))]
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        often, hit = Counter(windows), set()
        for i, x in enumerate(windows):
            if often[x] > 1:
                hit |= set(range(i, i + 5))
        assert repeated_words(w) == len(hit)


def test_rules_of_lines():
    for line, fails in (
        ("", False), ("A plain line of six words", False), ("Too short", True), ("Too short.", False), ("Short \t", True),
        ("Home | About us | News | Contact us all", True), ("this | is | a | long line of more than twenty words that merely has some bars in it and goes on and on and on", False),
        ("Copyright by us, All Rights Reserved.", True), ("we## use** many%% symbols$$ here", True),
        ("यह ठीक है।", False), ("यह ठीक है", True), ("هذا جيد؟", False), ("Firma X, Alle Rechte vorbehalten, seit 1990.", True),
        ("Nous utilisons des cookies sur ce site.", True), ("Todos los derechos reservados por la casa.", True), ("Alle haben hier die gleichen Rechte.", False),
    ):
        assert line_fails(line, len(line.split())) is fails, line


def test_documents(spark):
    good = "\n".join(prose(i, 12) + "." for i in range(6))
    texts = list(ODD) + [good, good + "\nMenu\n" + prose(9, 3) + "\n\n", "Menu\nHome\nNews\n" * 9 + good[:40], prose(1, 9), prose(1, 10), (prose(4, 15) + "\n") * 3]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in judge_lines(docs).collect()}
    assert [rows[i].kept for i in range(len(ODD))] == [False] * len(ODD)
    kept = [rows[i].kept for i in range(len(ODD), len(texts))]
    assert kept == [True, True, False, False, True, False]
    one = rows[len(ODD) + 1]
    assert one.cleaned_text == good + "\n\n" and one.n_dup_lines == 0 and one.n_words == 76
    last = rows[len(texts) - 1]
    assert (last.n_dup_lines, last.n_repeat_words, last.base_failed) == (2, 45, True)
    assert judge_lines(docs).columns[:5] == ["doc_id", "text", "lang", "source", "row"]
    cleaned = clean_lines(docs.drop("kept"))
    assert cleaned.columns == docs.drop("kept").columns and cleaned.count() == 3
    assert judge_lines(docs.limit(0)).count() == 0
