"""Registered queries beside their check SQL. ALL_QUERIES=1 runs every one of them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.check_queries import checking_engine, compare

SCALE = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SOME = [
    "validate_records", "quality_score", "reconcile_sources", "chain_replay", "holders_current", "chain_status",
    "order_decisions", "audit_append", "audit_verify", "request_limiter", "extract_fields", "apply_corrections",
    "correction_memory_holdout", "error_categories", "district_risk", "parcel_best_copy", "plot_overlaps", "words_to_lines",
]


@pytest.fixture(scope="module")
def engine():
    return checking_engine(SCALE)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SOME)
def test_query(spark, engine, name):
    verdict = compare(spark, engine, SCALE, name, QUERIES, ORACLES)
    assert verdict.startswith(("ok", "rows")), verdict


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
