"""The registered queries beside their check SQL, and the columns that their contracts name."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from landledger.llm import queries as llm
from tests.check_queries import checking_engine, compare

SCALE = "/root/testdata/sf0.001"
CONTRACTS = {
    "op2_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op3_best_fit_packing": [
        ("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint"),
    ],
    "op4_quality_rules": [
        ("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"),
        ("base_failed", "boolean"), ("kept", "boolean"),
    ],
    "op5_decontaminate": [
        ("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean"),
    ],
    "op6_near_dedup": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    "op11_fill_in_middle": [
        ("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"),
        ("output_sha256", "string"), ("restored_sha256", "string"),
    ],
    "op12_collocations": [
        ("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint"),
    ],
    "op13_syncmers": [
        ("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"),
        ("near_edited", "double"), ("near_next", "double"),
    ],
    "op10_line_dedup": [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")],
}


def test_all_are_registered():
    names = {n.split("_")[0] for n in llm.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert set(llm.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, name):
    df = entry.queries()[name](spark, SCALE)
    assert df.dtypes[:len(CONTRACTS[name])] == CONTRACTS[name]


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_check(spark, name):
    verdict = compare(spark, checking_engine(SCALE), SCALE, name, llm.QUERIES, llm.ORACLES)
    assert verdict.startswith("ok"), verdict
