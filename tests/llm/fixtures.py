"""Small tables with the odd cases that every operator must stand."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def documents(spark, texts, clash: str = ""):
    """doc_id, text, and columns that operators may use themselves."""
    rows = [(i, t, "en", "s", "x", 7) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, row string, kept int"
    return spark.createDataFrame(rows, schema)


ODD = [None, "", "\n", " \n\t ", "one", "ONE", "one", "naïve — ünïcode ΑΒΓ", "!!! ??? ...", "a" * 5000]
