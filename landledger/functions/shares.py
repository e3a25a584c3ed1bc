"""Exact fractions for ownership shares: SQL text for columns, and a small Python twin.

The SQL forms work on pairs of whole numbers of 38 digits; the Python twin is used inside the
register replay, where sums over many heirs may outgrow them.
"""

from __future__ import annotations

import re
from math import gcd

from landledger import fixed
from landledger.functions.text import BLANK, heading_skeleton, let, quoted, pattern, trim

WIDE = "decimal(38,0)"
FRACTION = f"struct<n:{WIDE},d:{WIDE}>"

# Divisions that Euclid's algorithm takes at most, for any two bigints and for any two numbers of 38 digits.
_EUCLID_STEPS, _WIDE_STEPS = 93, 184
# A division keeps 32 digits before the point, so a quotient by less than this is worked out in two limbs.
_MOST = "9000000000000000000"
_SMALL, _LIMB = "1000000BD", "10000000000000000000BD"


def _spelled_out(value: str) -> str:
    text = trim(value)
    for sign, plain in fixed.VULGAR_FRACTIONS:
        # Only the first of each sign is replaced; a second one is not a share anyway.
        text = f"regexp_replace({text}, '^([^{sign}]*){sign}', '$1{plain}')"
    return text


def _size(x: str, kind: str) -> str:
    """The number without its sign; abs() and a minus sign alone round decimals to 34 digits."""
    return f"cast(if({x} < 0, 0 - {x}, {x}) as {kind})"


def _euclid(a: str, b: str, kind: str, steps: int) -> str:
    return (
        f"aggregate(sequence(1, {steps}), named_struct('a', {_size(a, kind)}, 'b', {_size(b, kind)}), "
        f"(s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', cast(s.a % s.b as {kind}))), "
        f"s -> cast(if(s.a = 0, 1, s.a) as {WIDE}))"
    )


def _gcd(a: str, b: str) -> str:
    """Greatest common divisor, on bigints where both are such. The worst pairs are successive Fibonacci numbers."""
    narrow = " and ".join(f"{x} between -{_MOST} and {_MOST}" for x in (a, b))
    return f"if({narrow}, {_euclid(f'cast({a} as bigint)', f'cast({b} as bigint)', 'bigint', _EUCLID_STEPS)}, {_euclid(a, b, WIDE, _WIDE_STEPS)})"


def _parted(n: str, g: str) -> str:
    """``n`` divided by its divisor ``g``."""
    rest = f"({n} % {_LIMB})"
    high = f"cast(({n} - {rest}) / {_LIMB} as {WIDE})"
    limbs = let(
        f"named_struct('h', {high}, 'l', cast({rest} as {WIDE}))", "w",
        f"cast((w.h - w.h % {g}) / {g} as {WIDE}) * {_LIMB} + cast(cast((w.h % {g}) * {_LIMB} + w.l as {WIDE}) / {g} as {WIDE})",
    )
    return f"case when {g} = 1 then {n} when {g} < {_SMALL} then cast({limbs} as {WIDE}) else cast({n} / {g} as {WIDE}) end"


def reduced(n: str, d: str) -> str:
    """Fraction in lowest terms; ``d`` must be positive. Null when one of them is."""
    pair = f"named_struct('n', cast({n} as {WIDE}), 'd', cast({d} as {WIDE}))"
    lowest_terms = let(_gcd("f.n", "f.d"), "g", f"named_struct('n', {_parted('f.n', 'g')}, 'd', {_parted('f.d', 'g')})")
    return let(pair, "f", f"case when f.n is null or f.d is null then null when f.d = 1 then f else {lowest_terms} end")


def parse_share(value: str) -> str:
    """Share as written ("1", "1/2", "0.5", "½") as a fraction; null when it is none.

    Numerator and denominator must fit 38 digits; decimals lose their zeros at the end first.
    """
    blanks = f"{BLANK}*"
    slash = f"^([0-9]+){blanks}/{blanks}([0-9]+)\\z"
    decimal = "^([0-9]+)(?:\\.([0-9]+))?\\z"

    def part(regex: str, group: int) -> str:
        return f"try_cast(regexp_extract(t, {pattern(regex)}, {group}) as {WIDE})"

    tail = f"rtrim('0', regexp_extract(t, {pattern(decimal)}, 2))"
    scale = f"try_cast(rpad('1', length({tail}) + 1, '0') as {WIDE})"
    digits = f"try_cast(concat(regexp_extract(t, {pattern(decimal)}, 1), {tail}) as {WIDE})"
    return let(
        _spelled_out(value), "t",
        f"case when rlike(t, {pattern(slash)}) then if({part(slash, 2)} > 0, {reduced(part(slash, 1), part(slash, 2))}, null) "
        f"when rlike(t, {pattern(decimal)}) then {reduced(digits, scale)} end",
    )


def share_text(fraction: str) -> str:
    return f"if({fraction}.d = 1, cast({fraction}.n as string), concat({fraction}.n, '/', {fraction}.d))"


def _joined(a: str, b: str, body: str) -> str:
    """``body`` with x and y: both numerators over the least common denominator z; null beyond 38 digits."""
    parts = let(
        _gcd(f"{a}.d", f"{b}.d"), "k",
        f"named_struct('x', try_multiply({a}.n, {_parted(f'{b}.d', 'k')}), 'y', try_multiply({b}.n, {_parted(f'{a}.d', 'k')}), "
        f"'z', try_multiply({a}.d, {_parted(f'{b}.d', 'k')}))",
    )
    return let(parts, "j", body)


def share_sum(a: str, b: str) -> str:
    return _joined(a, b, reduced("try_add(j.x, j.y)", "j.z"))


def share_difference(a: str, b: str) -> str:
    return _joined(a, b, reduced("try_subtract(j.x, j.y)", "j.z"))


def share_sign(a: str, b: str) -> str:
    """-1, 0 or 1 as a is less than, equal to or more than b."""
    return _joined(a, b, "case when j.x < j.y then -1 when j.x = j.y then 0 when j.x > j.y then 1 end")


def normalised_share(value: str) -> str:
    """Share text of an order: words for the whole become "1", fractions are reduced."""
    whole = ", ".join(
        quoted(re.sub(f"[{fixed.MARKS}{fixed.BLANKS}{fixed.DASHES}:·.|]", "", w.lower()))
        for w in fixed.WHOLE_WORDS
    )
    fraction = let(parse_share(value), "f", share_text("f"))
    return f"if({heading_skeleton(trim(value))} in ({whole}), '1', {fraction})"


# --- Python twin ---------------------------------------------------------

_SIGNS = dict(fixed.VULGAR_FRACTIONS)
_BLANK = re.compile(f"^[{fixed.BLANKS}]+|[{fixed.BLANKS}]+$")
_SLASH = re.compile(f"([0-9]+)[{fixed.BLANKS}]*/[{fixed.BLANKS}]*([0-9]+)")
_DECIMAL = re.compile("([0-9]+)(?:[.]([0-9]+))?")


def lowest(n: int, d: int) -> tuple[int, int]:
    g = gcd(n, d) or 1
    return n // g, d // g


def read_share(raw: str | None) -> tuple[int, int] | None:
    """The share as a pair in lowest terms, or None."""
    if raw is None:
        return None
    text = _BLANK.sub("", raw)
    for sign, plain in _SIGNS.items():
        text = text.replace(sign, plain, 1)
    m = _SLASH.fullmatch(text)
    if m:
        d = int(m[2])
        return lowest(int(m[1]), d) if d else None
    m = _DECIMAL.fullmatch(text)
    if m:
        scale = 10 ** len(m[2] or "")
        return lowest(int(m[1] + (m[2] or "")), scale)
    return None


def plus(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return lowest(a[0] * b[1] + b[0] * a[1], a[1] * b[1])


def minus(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return lowest(a[0] * b[1] - b[0] * a[1], a[1] * b[1])


def exceeds(a: tuple[int, int], b: tuple[int, int]) -> int:
    return a[0] * b[1] - b[0] * a[1]


def shown(a: tuple[int, int]) -> str:
    return str(a[0]) if a[1] == 1 else f"{a[0]}/{a[1]}"
