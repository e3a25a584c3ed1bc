"""Previews in one pass against a replay for every proposed entry."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from landledger import fixed
from landledger.operators import chain, orders
from landledger.operators.chain import Previews, Register

NAMES = ["ram prasad", "shri ram prasad", "ram prasadh", "shyam lal", "mohan", "gita devi", "gita", "devi gita", "anil k", "sunita"]


def register(rng, parcel, n):
    rows, day = [], date(1990, 1, 1)
    for seq in range(1, n + 1):
        day += timedelta(days=rng.choice([0, 0, 1, 300]))
        kind = rng.choice(["ORIGINAL", "SALE", "SALE", "INHERITANCE", "INHERITANCE", "GIFT"])
        giver = None if kind == "ORIGINAL" or rng.random() < 0.05 else rng.choice(NAMES)
        rows.append((parcel, day, seq, parcel * 1000 + seq, kind, giver, rng.choice(NAMES), rng.choice(["1", "1/2", "1/2", "1/3", "2/3", "half", "0", "3/2"])))
    return rows


def proposals(rng, parcel, rows, n):
    days = [r[1] for r in rows] or [date(1990, 1, 1)]
    last = max([r[2] for r in rows], default=0) + 1
    out = []
    for k in range(n):
        day = rng.choice(days) + timedelta(days=rng.choice([0, 0, 0, -1, 1, -400, 400]))
        out.append((parcel, day, last, -1, rng.choice(["SALE", "INHERITANCE", "INHERITANCE", "GIFT"]), rng.choice(NAMES), rng.choice(NAMES), rng.choice(["1", "1/2", "1/3", "2"]), 5000 + k))
    return out


def found(state, rows):
    out = []
    for r in rows:
        out += state.feed(r)
    out += state.finish()
    return [r for r in out if r[1] in ("finding", "fork")]


@pytest.mark.parametrize("seed", range(6))
def test_forks_equal_replays_of_their_own(seed):
    rng = random.Random(seed)
    added = 0
    for case in range(150):
        rows = sorted(register(rng, 1, rng.randrange(14)), key=lambda r: (r[1], r[2]))
        asked = proposals(rng, 1, rows, rng.randrange(1, 6))
        base = {(r[4], r[3], r[8]) for r in found(Register(1, False), rows)}
        both = sorted([(*r, None) for r in rows] + asked, key=lambda r: (r[1], r[8] is not None, r[2], r[8] or 0))
        got = found(Previews((1, None)), [(r[0], None, *r[1:]) for r in both])
        assert {(r[4], r[3], r[8]) for r in got if r[1] == "finding"} == base
        for p in asked:
            alone = found(Register(1, False), sorted([*rows, p[:8]], key=lambda r: (r[1], r[3] == -1, r[2])))
            want = [(r[4], r[3], r[8]) for r in alone if (r[4], r[3], r[8]) not in base]
            mine = [(r[4], r[3], r[8]) for r in got if r[1] == "fork" and r[14] == p[8] and (r[4], r[3], r[8]) not in base]
            assert mine == want, (rows, p)
            added += len(want)
    assert added > 100


def test_a_register_is_passed_once(monkeypatch):
    """Entries that name nobody a fork has changed cost it nothing."""
    applied = []
    plain = Register._apply
    monkeypatch.setattr(Register, "_apply", lambda self, book, *rest: applied.append(book) or plain(self, book, *rest))
    day = date(1990, 1, 1)
    rows = [(1, day, 1, 1, "ORIGINAL", None, "first owner", "1/2")]
    rows += [(1, day + timedelta(days=n), n + 1, n + 1, "ORIGINAL", None, f"owner{n}x other{n}y", "0") for n in range(1, 301)]
    asked = [(1, day + timedelta(days=1), 400, -1, "SALE", "first owner", f"buyer{k}q of{k}z", "1/4", k) for k in range(50)]
    both = sorted([(*r, None) for r in rows] + asked, key=lambda r: (r[1], r[8] is not None, r[2], r[8] or 0))
    found(Previews((1, None)), [(r[0], None, *r[1:]) for r in both])
    assert len(applied) == len(rows) + len(asked)


def test_orders_without_a_register(spark):
    schema = "parcel_id bigint, document_id bigint, id bigint, seq int, type string, from_owner string, to_owner string, share string, mutation_number string, effective_date date"
    asked = spark.createDataFrame([(None, k, -1, 1, "SALE", "a b", "c d", "3/2", None, date(2000, 1, 1)) for k in (7, 8)], schema)
    rows = chain.forked_replay(asked.drop("document_id").limit(0), asked).collect()
    assert sorted((r.document_id, r.row_kind, r.kind) for r in rows) == [
        (7, "fork", "sharesExceedWhole"), (7, "fork", "titleNotTraced"), (8, "fork", "sharesExceedWhole"), (8, "fork", "titleNotTraced"),
    ]


def test_registers_and_orders_are_worked_out_once(spark):
    looked = {"entries": spark.sparkContext.accumulator(0), "orders": spark.sparkContext.accumulator(0)}

    def counted(which, kind):
        def look(value):
            looked[which].add(1)
            return value
        return F.udf(look, kind).asNondeterministic()

    entries = [(8, 1, 1, "ORIGINAL", "1", "asha", None, "M-1", date(2001, 1, 1), None), (9, 2, 1, "ORIGINAL", "1", "ravi", None, "M-2", date(2001, 1, 1), None)]
    columns = (
        "id bigint, parcel_id bigint, seq int, type string, share string, to_owner string, from_owner string, mutation_number string, "
        "effective_date date, supersedes_id bigint"
    )
    register = spark.createDataFrame(entries, columns).withColumn("seq", counted("entries", "int")("seq"))
    parcels = spark.createDataFrame([(1, "5", "rampur", "east", "t"), (2, "6", "rampur", "east", "t")], "parcel_id bigint, khasra_number string, village string, district string, tehsil string")
    order = (7, "5/2025", "01/02/2025", "Sale", "mina", "zoya", "1/2", None, "5", "rampur", "east")
    read = spark.createDataFrame([order], "document_id bigint, " + ", ".join(f"{f} string" for f in fixed.ORDER_FIELDS))
    read = read.withColumn("confidence", F.expr("map('share', 0.9D)")).withColumn("khasra_number", counted("orders", "string")("khasra_number"))
    got = orders.order_preview(read, parcels, register, "2026-09-11").collect()
    assert [(r.document_id, r.parcel_id, r.introduced) for r in got] == [(7, 1, ["chainBreak"])]
    assert {k: v.value for k, v in looked.items()} == {"entries": 2, "orders": 1}
    # Registers for which nothing is proposed are not replayed.
    asked = register.withColumn("document_id", F.expr("if(parcel_id = 1, 7L, null)"))
    assert {r.parcel_id for r in chain.forked_replay(register, asked.filter("parcel_id = 1")).collect()} == {1}
