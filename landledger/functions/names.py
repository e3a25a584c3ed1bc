"""Comparison of person and place names, as SQL expression text."""

from __future__ import annotations

from landledger import fixed
from landledger.functions.text import half_up_at, let

COMPARISON = "struct<score:double,verdict:string,subset:boolean>"


def token_similarity(a: str, b: str) -> str:
    """1 for equal skeletons, falling with the edits between them."""
    return (
        f"if({a} = {b}, 1.0D, greatest(0.0D, 1.0D - levenshtein({a}, {b}) "
        f"/ cast(greatest(length({a}), length({b})) as double)))"
    )


def same_place(a: str, b: str) -> str:
    """Whether two place keys name one place; both must be non-empty."""
    return f"({a} <> '' and {b} <> '' and {token_similarity(a, b)} >= {fixed.PLACE_MATCH}D)"


def compare_names(left: str, right: str) -> str:
    """Compare two names given as skeleton arrays: struct(score, verdict, subset).

    Each word of the shorter name claims its best unclaimed partner in the longer
    one; the first of equals wins. The score is measured against the longer name.
    """
    scored = (
        "transform(n.b, (other, i) -> struct(if(array_contains(acc.taken, i), -1.0D, "
        + token_similarity("token", "other")
        + ") as score, -i as rank))"
    )
    claim = let(
        f"array_max({scored})",
        "best",
        f"if(best.score >= {fixed.TOKEN_MATCH}D, "
        "named_struct('matched', acc.matched + best.score, 'taken', array_append(acc.taken, -best.rank)), acc)",
    )
    fold = (
        "aggregate(n.a, named_struct('matched', 0.0D, 'taken', cast(array() as array<int>)), "
        f"(acc, token) -> {claim})"
    )
    judged = let(
        fold,
        "s",
        "named_struct('score', "
        + half_up_at("(s.matched / size(n.b))", 3)
        + f", 'verdict', case when s.matched / size(n.b) >= {fixed.NAME_SAME}D then 'same' "
        f"when s.matched / size(n.b) >= {fixed.NAME_VARIANT}D or size(s.taken) = size(n.a) then 'variant' "
        "else 'different' end, 'subset', size(s.taken) = size(n.a))",
    )
    ordered = (
        f"if(size({left}) <= size({right}), named_struct('a', {left}, 'b', {right}), "
        f"named_struct('a', {right}, 'b', {left}))"
    )
    return (
        f"cast(case when size({left}) <= 0 or size({right}) <= 0 or {left} is null or {right} is null "
        "then named_struct('score', 0.0D, 'verdict', 'different', 'subset', false) "
        f"when {left} = {right} then named_struct('score', 1.0D, 'verdict', 'same', 'subset', true) "
        f"else {let(ordered, 'n', judged)} end as {COMPARISON})"
    )


def names_agree(left: str, right: str) -> str:
    """Whether :func:`compare_names` finds the same person.

    No more words match than the shorter name has, so names of very different lengths need no comparing.
    """
    least = int(fixed.NAME_SAME * 100)
    within = f"least(size({left}), size({right})) * 100 >= greatest(size({left}), size({right})) * {least}"
    return f"coalesce({left} = {right} and size({left}) > 0 or {within} and {compare_names(left, right)}.verdict = 'same', false)"
