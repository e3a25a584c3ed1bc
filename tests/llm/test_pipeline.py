from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_decontaminate, test_line_dedup, test_near_dup, test_packing
from tests.llm.fixtures import ODD, prose
from tests.llm.test_language import text as language_text


def documents(spark):
    rng = random.Random(4)
    common, item = prose(1, 12), prose(500, 14)
    texts = [(t, "aa") for t in ODD]
    for i in range(60):
        lang = ["aa", "bb", "cc"][i % 3]
        lines = [language_text(lang, rng) for _ in range(3)]
        if i % 4 == 0:
            lines.insert(1, common)
        if i % 7 == 0:
            lines.append("so " + item + " it was")
        texts.append(("\n".join(lines), lang))
        if i % 5 == 0:
            texts.append(("\n".join(lines) + " more", lang))
    rows = [(i, t, lang if i % 10 else None, "s", len(t or ""), "x") for i, (t, lang) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return docs, spark.createDataFrame([(1, item)], "item_id long, text string")


def test_stages(spark, tmp_path):
    docs, bench = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    now, last = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        rows = [r.asDict() for r in out.collect()]
        before = {r.doc_id: r.text for r in now.collect()}
        ids = sorted(before)
        if name == "language":
            assert {k for k in before if k not in {r["doc_id"] for r in rows}} >= {0, 1, 2, 3, 8}
        elif name == "lines":
            # By position, for the test's own counting goes by position too.
            want = test_line_dedup.by_hand([before[k] for k in ids])
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows} == {k: (want[i][0], len(want[i][0])) for i, k in enumerate(ids)}
            assert any(v[2] for v in want.values())
        elif name == "near_duplicates":
            want = test_near_dup.by_hand([before[k] for k in ids])
            assert {r["doc_id"] for r in rows} == {k for i, k in enumerate(ids) if want[i][2]} != set(ids)
        elif name == "benchmark":
            want = test_decontaminate.by_hand([before[k] for k in ids], [(r.item_id, r.text) for r in bench.collect()])
            assert {r["doc_id"] for r in rows} == {k for i, k in enumerate(ids) if not want[i][1]} != set(ids)
        else:
            assert sum(r["length"] for r in rows) == sum(len(test_packing.whole(t)) + 1 for t in before.values())
            last = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows}
            break
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole} == last


def test_empty(spark, tmp_path):
    docs, bench = documents(spark)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert docs.join(kept, "doc_id", "left_anti").filter(F.col("text").rlike("[A-Za-z]{3}")).count() == 0


def test_near_duplicates_by_five_words(spark):
    words = prose(77, 80).split()
    edited = [*words[:26], "one", *words[27:53], "two", *words[54:]]
    texts = [" ".join(words), " ".join(edited), " ".join([*words[:40], "one", *words[41:]]), prose(78, 80)]

    def by_hand(size):
        sets = [{tuple(t.split()[i:i + size]) for i in range(81 - size)} for t in texts]
        return {i for i, s in enumerate(sets) if not any(100 * len(s & o) >= 80 * len(s | o) for o in sets[:i])}

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    assert by_hand(4) != by_hand(5) == kept
