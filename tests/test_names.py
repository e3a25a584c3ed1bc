"""Names and places against brute force, in both scripts."""

from __future__ import annotations

import random

from landledger.functions import names, text
from landledger.operators import places
from landledger.operators.chain import same_person

PAIRS = [
    ("सुनीता देवी", "सुनीता देवी मिश्रा"), ("मलिहाबाद", "मलहिबाद"), ("श्री रमेश कुमार", "रमेश कुमार"),
    ("ramesh kumar verma", "remesh kumer verma"), ("a b", "c d"), (None, "x"), ("shri", "shri"), ("x y x", "x x"),
]


def test_known_pairs(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    got = df.selectExpr(f"{names.compare_names(text.name_key('a'), text.name_key('b'))} as m").selectExpr("m.*").collect()
    assert [(r.score, r.verdict, r.subset) for r in got] == [
        (0.667, "variant", True), (1.0, "same", True), (1.0, "same", True), (0.878, "variant", True),
        (0.0, "different", False), (0.0, "different", False), (0.0, "different", False), (0.667, "variant", True),
    ]


def test_column_and_python_forms_agree(spark):
    rng = random.Random(7)
    words = ["राम", "रामू", "श्याम", "देवी", "kumar", "kumer", "ram", "rama", "of", "shri", "verma", "varma", "लाल"]
    pairs = [tuple(" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in "ab") for _ in range(600)]
    df = spark.createDataFrame(pairs, "a string, b string")
    verdict = names.compare_names(text.name_key("a"), text.name_key("b"))
    for r in df.selectExpr("a", "b", f"{verdict}.verdict as v").collect():
        assert (r.v == "same") == same_person(r.a, r.b), r


def test_agreeing_is_the_verdict_same(spark):
    rng = random.Random(11)
    words = ["राम", "रामू", "देवी", "kumar", "kumer", "ram", "rama", "of", "shri", "verma", "varma", "abcdefghijklmnopqrst", "abcdefghijklmnopqrsu"]
    pairs = [tuple(" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in "ab") for _ in range(600)]
    long = [" ".join(f"word{chr(97 + i)}{chr(98 + i)}" for i in range(n)) for n in (22, 23, 24, 25)]
    df = spark.createDataFrame(pairs + PAIRS + [(a, b) for a in long for b in long], "a string, b string")
    a, b = text.name_key("a"), text.name_key("b")
    got = df.selectExpr(f"{names.compare_names(a, b)}.verdict = 'same' as same", f"{names.names_agree(a, b)} as agree").collect()
    assert all(r.same == r.agree for r in got) and 10 < sum(r.agree for r in got) < len(got)


def test_blanks_are_unicode(spark):
    df = spark.createDataFrame([("  x　",), (" ",), (None,)], "v string")
    assert [r[0] for r in df.selectExpr(text.folded("v")).collect()] == ["x", "", ""]
    assert [r[0] for r in df.selectExpr(text.filled("v")).collect()] == [True, False, False]


def test_numbers(spark):
    df = spark.createDataFrame([("1.2 ha",), ("20000.000",), ("x1",), ("0.00005",), ("",)], "v string")
    rows = df.selectExpr(text.leading_number("v"), text.whole_number("v"), text.number_text(text.leading_number("v"))).collect()
    assert [tuple(r) for r in rows] == [
        (1.2, None, "1.2"), (20000.0, 20000.0, "20000"), (None, None, None), (0.00005, 0.00005, "0.00005"), (None, None, None),
    ]


def test_blocking_misses_no_pair(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abc ", k=n)).strip() or "x" for n in [3, 6, 7, 8, 13, 14, 19, 20, 26, 27, 33, 40, 48, 49, 60] * 4]
    found = set(base)
    for name in base:
        for _ in range(4):
            chars = list(name)
            for _ in range(rng.randint(1, max(1, len(name) // 6))):
                i = rng.randrange(len(chars))
                chars[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
                chars = chars or ["a"]
            found.add("".join(chars))
    df = spark.createDataFrame([("p", n) for n in found if n], "kind string, name string")
    got = {(r.a, r.b) for r in places.similar_names(df).collect()}
    pairs = df.selectExpr("name as a").join(df.selectExpr("name as b"))
    want = {(r.a, r.b) for r in pairs.filter(names.same_place("a", "b")).collect()}
    assert got == want and len(want) > len(found)


def test_blocking_of_long_names(spark):
    # Names of 10 to 300 letters in two kinds, with a beginning that all have and runs that recur.
    rng = random.Random(5)
    found = set()
    for n in [10, 30, 39, 44, 47, 49, 55, 57, 80, 120, 200, 300] * 3:
        name = "gram panchayat "[:n // 2] + "".join(rng.choices("abcdefg ", k=n - n // 2))
        if n % 4 == 0:
            name = name[:n // 2] + "ab" * (n // 4)
        found.add(name.strip())
        for most in (1, n // 10, n * 15 // 100, n * 15 // 100 + 1):
            chars = list(name)
            for _ in range(most):
                i = rng.randrange(len(chars))
                chars[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "h"])
            found.add("".join(chars).strip())
    df = spark.createDataFrame([(k, n) for n in found if n for k in ("p", "q")], "kind string, name string")
    got = {(r.kind, r.a, r.b) for r in places.similar_names(df).collect()}
    pairs = df.selectExpr("kind", "name as a").join(df.selectExpr("kind", "name as b"), "kind")
    want = {(r.kind, r.a, r.b) for r in pairs.filter(names.same_place("a", "b")).collect()}
    assert got == want and sum(len(a) > places.PIECE_LIMIT for _, a, b in want if a != b) > 50
    # Names of like length that have nothing in common are not laid side by side.
    apart = spark.createDataFrame([("p", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60))) for _ in range(300)], "kind string, name string")
    assert places.long_candidates(apart).count() < 450


def test_place_pairs_are_not_transitive(spark):
    rows = [("aaaaaaaa", "d"), ("aaaaaaab", "d"), ("aaaaaabb", "d"), ("aaaaaaaa", "zz")]
    pairs = places.place_pairs(spark.createDataFrame(rows, "village_key string, district_key string"))
    got = {(r.village_key, r.other_village) for r in pairs.collect() if r.district_key == "d"}
    assert ("aaaaaaaa", "aaaaaaab") in got and ("aaaaaaab", "aaaaaabb") in got and ("aaaaaaaa", "aaaaaabb") not in got
    assert all(r.other_district == r.district_key for r in pairs.collect())
