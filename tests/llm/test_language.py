from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from landledger.llm.language import Features, fit, fitted_temperature, held_out, predict, softmax
from tests.llm.fixtures import ODD, documents

SYLLABLES = {"aa": "ka to mi su ren".split(), "bb": "ble ing tion sh er".split(), "cc": "ção lho ã nha é".split()}


def text(lang, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)) + "."


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, text(k, rng), k) for i, k in enumerate(sorted(SYLLABLES) * 80)]
    docs = spark.createDataFrame(rows + [(1000, None, "aa"), (1001, "text", None)], "doc_id long, text string, lang string")
    docs = docs.withColumn("held_out", held_out())
    model = fit(docs.filter("not held_out"), per_language=40)
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.5
    got = predict(docs, model).filter("held_out and lang is not null and text is not null").collect()
    assert len(got) > 20 and all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got)


def test_odd_texts(spark):
    docs = documents(spark, [*ODD, "中国 русский", "𝔘𝔫𝔦"]).withColumn("score", F.lit(0.0))
    rng = random.Random(1)
    known = spark.createDataFrame([(i, text("bb", rng), "bb") for i in range(9)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in predict(docs, fit(known)).collect()}
    assert [rows[i].lang_pred for i in range(len(ODD) + 2)] == ["und"] * 4 + ["bb"] * 4 + ["und"] + ["bb"] * 3
    assert rows[0].score == 0.0 and rows[4].score == 1.0
    assert predict(docs, None).select("lang_pred").distinct().collect()[0][0] == "und"
    assert fit(known.limit(0)) is None and predict(docs.limit(0), None).count() == 0




def test_features_and_temperature():
    f = Features()
    assert f("...  12 3") is None and f("") is None
    a, b = f("Ab, cd"), f("ab  CD!")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    logits = [np.array([9.0, 0.0]), np.array([9.0, 0.0]), np.array([0.0, 9.0]), np.array([9.0, 0.0])] * 50
    t = fitted_temperature(logits, [0, 0, 1, 1] * 50)
    assert abs(softmax(logits[0] / t)[0] - 0.75) < 0.02
    sure = [np.array([9.0, 0.0])] * 98
    assert abs(softmax(sure[0] / fitted_temperature(sure, [0] * 98))[0] - 0.99) < 0.002
