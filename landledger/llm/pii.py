"""Format-preserving pseudonyms: validated numbers and dates, permuted by key within their format.

Every kind of finding is a whole number below a*b, split into a left part below a and a right
part below b. A Feistel network adds a keyed digest of one part to the other, in turns; this
is a permutation for every a and b, so equal values stay equal, different ones different, and
all stay valid. Mixed text (the name in an address, secrets) goes the same way, character by
character within its class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: The key of the registered query, whose results must be the same in every run. Real data needs a key of its own.
KEY = "landledger"

# The formats.
CARD = r"(?<![\d.,+-])\d(?:[ -]?\d){12,18}(?![\d-])"
PHONE = r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
BARE_PHONE = r"(?<![\d+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)"
SOCIAL = r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ADDRESS = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
DATE = r"(?<![\d-])[12]\d{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])"
DAY_FIRST = r"(?<![\d./])(?:0[1-9]|[12]\d|3[01])[./](?:0[1-9]|1[0-2])[./][12]\d{3}(?![\d./])"
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,}"
#: A name in any case, then = or : with blanks and quotes around.
NAME = r"(?i:password|passwd|api[_ -]?key|token|secret)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?"
VALUE = "A-Za-z0-9_+/=!@#$%^&*~-"
#: The first two looks only turn most places away soon.
NAMED = rf"(?=[{VALUE}]{{8}})(?<=[=:][ \t\"']{{0,5}})(?<={NAME})"
BEARER = r"(?<=[rR][ \t])(?<=(?i:bearer)[ \t])[A-Za-z0-9._~+/=-]{16,}"
SECRET = NAMED + rf"[{VALUE}]{{8,}}|{BEARER}|(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])"
#: What stands before a secret.
LEAD = rf"(?:{NAME}|(?i:bearer)[ \t])$"
#: Characters within which LEAD is looked for.
LEAD_LENGTH = 32
KINDS = {
    "mail": MAIL, "secret": SECRET, "date": DATE, "day_first": DAY_FIRST, "address": ADDRESS,
    "social": SOCIAL, "phone": PHONE, "bare_phone": BARE_PHONE, "card": CARD,
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Days after which the calendar repeats; a date stays within its 400 years.
CYCLE_LEFT, CYCLE_RIGHT = 773, 189


def _digest(key: str, label: str, turn: int, part: Column, below: Column) -> Column:
    """A number from 0 to below - 1 that hangs on key, kind, turn and part."""
    text = F.concat(F.lit(f"{key}|{label}|{turn}|"), part.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), below)


def _over(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _with(function: Callable[[Column, int], Column], turn: int) -> Callable[[Column], Column]:
    return lambda x: function(x, turn)


def permuted(value: Column, left: Column, right: Column, key: str, label: str) -> Column:
    """``value`` (0 to left * right - 1) under the keyed permutation."""

    def turn(x: Column, t: int) -> Column:
        b = F.pmod(x, right)
        a = _over(x, right)
        if t % 2:
            b = F.pmod(b + _digest(key, label, t, a, right), right)
        else:
            a = F.pmod(a + _digest(key, label, t, b, left), left)
        return a * right + b

    # Each turn is applied to a one-element array, so that its input is worked out once.
    state = F.array(value)
    for t in range(ROUNDS):
        state = F.transform(state, _with(turn, t))
    return F.element_at(state, 1)


def _mixed(text: Column, key: str, label: str) -> Column:
    """Letters and digits permuted within their class, all else as it is."""

    def moved(part: Column, other: Column, turn: int) -> Column:
        def one(c: Column, i: Column) -> Column:
            digest = F.sha2(F.concat(F.lit(f"{key}|{label}|{turn}|"), _over(i, F.lit(32)).cast("string"), F.lit("|"), other), 256)
            by = F.conv(F.substr(digest, (1 + 2 * F.pmod(i, F.lit(32))).cast("int"), F.lit(2)), 16, 10).cast("int")
            out = c
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                last = chr(ord(first) + size - 1)
                out = F.when(c.between(first, last), F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + by, F.lit(size)))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(part, ""), one), "")

    half = F.ceil(F.char_length(text) / 2).cast("int")
    state = F.array(F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b")))

    def turned(x: Column, turn: int) -> Column:
        a, b = (x["a"], moved(x["b"], x["a"], turn)) if turn % 2 else (moved(x["a"], x["b"], turn), x["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    for t in range(ROUNDS):
        state = F.transform(state, _with(turned, t))
    return F.concat(F.element_at(state, 1)["a"], F.element_at(state, 1)["b"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refilled(text: Column, digits: Column) -> Column:
    """``text`` with its digits, in order, replaced by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(acc["out"], F.when(digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["out"])


def _check_sum(digits: Column, odd: int) -> Column:
    """Sum of the digits, every second one doubled with its digits added, counted from the end."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == odd, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), worth), F.lit(0), lambda a, x: a + x)


def _long(text: Column) -> Column:
    return text.cast("long")


def _padded(number: Column, width: int | Column) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _card(text: Column, key: str) -> Column:
    d = _digits(text)
    n = F.char_length(d) - 1
    left, right = [F.rpad(F.lit("1"), x.cast("int"), "0").cast("long") for x in (_over(n + 1, F.lit(2)) + 1, _over(n, F.lit(2)) + 1)]
    body = _padded(permuted(_long(F.substr(d, F.lit(1), n)), left, right, key, "card"), n)
    check = F.pmod(10 - F.pmod(_check_sum(body, 0), F.lit(10)), F.lit(10)).cast("string")
    return F.when(F.pmod(_check_sum(d, 1), F.lit(10)) == 0, _refilled(text, F.concat(body, check))).otherwise(text)


def _phone(text: Column, key: str) -> Column:
    """Numbers with both codes from 200 up stay such; all others are permuted among themselves."""
    d = F.right(_digits(text), F.lit(10))
    area, code, line = [_long(F.substr(d, F.lit(at), F.lit(n))) for at, n in ((1, 3), (4, 3), (7, 4))]

    def put(number: Column, area: Column, code: Column) -> Column:
        return F.concat(_padded(area, 3), _padded(code, 3), _padded(F.pmod(number, F.lit(10000)), 4))

    def usual(number: Column) -> Column:
        place = _over(number, F.lit(10000))
        return put(number, _over(place, F.lit(800)) + 200, F.pmod(place, F.lit(800)) + 200)

    def other(number: Column) -> Column:
        place = _over(number, F.lit(10000))
        low, rest = place < 200000, place - 200000
        return put(
            number, F.when(low, _over(place, F.lit(1000))).otherwise(_over(rest, F.lit(200)) + 200),
            F.when(low, F.pmod(place, F.lit(1000))).otherwise(F.pmod(rest, F.lit(200))),
        )

    high = (area - 200) * 800 + code - 200
    rest = F.when(area < 200, area * 1000 + code).otherwise(200000 + (area - 200) * 200 + code)
    new = F.when((area >= 200) & (code >= 200), usual(permuted(high * 10000 + line, F.lit(640000), F.lit(10000), key, "phone"))).otherwise(
        other(permuted(rest * 10000 + line, F.lit(360000), F.lit(10000), key, "phone_other"))
    )
    return _refilled(text, F.concat(F.when(text.startswith("+1"), "1").otherwise(""), new))


def _social(text: Column, key: str) -> Column:
    area, group, serial = [_long(F.substr(text, F.lit(at), F.lit(n))) for at, n in ((1, 3), (5, 2), (8, 4))]
    area = area - 1 - (area > 666).cast("int")
    number = permuted((area * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99), F.lit(9999), key, "social")
    place = _over(number, F.lit(9999))
    area = _over(place, F.lit(99)) + 1
    area = area + (area >= 666).cast("int")
    return F.concat_ws("-", _padded(area, 3), _padded(F.pmod(place, F.lit(99)) + 1, 2), _padded(F.pmod(number, F.lit(9999)) + 1, 4))


def _address(text: Column, key: str) -> Column:
    value = F.aggregate(F.split(text, "[.]"), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    number = permuted(value, F.lit(65536), F.lit(65536), key, "address")
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _date(text: Column, key: str) -> Column:
    """Year first, or day first with its separator."""
    first = F.substr(text, F.lit(5), F.lit(1)) == "-"
    iso = F.when(first, text).otherwise(F.concat_ws("-", F.right(text, F.lit(4)), F.substr(text, F.lit(4), F.lit(2)), F.substr(text, F.lit(1), F.lit(2))))
    start, cycle = F.lit("0001-01-01").cast("date"), CYCLE_LEFT * CYCLE_RIGHT
    days = F.datediff(iso.try_cast("date"), start).cast("long")
    new = permuted(F.pmod(days, F.lit(cycle)), F.lit(CYCLE_LEFT), F.lit(CYCLE_RIGHT), key, "date")
    out = F.date_add(start, (new + _over(days, F.lit(cycle)) * cycle).cast("int")).cast("string")
    mark = F.substr(text, F.lit(3), F.lit(1))
    turned = F.concat(F.substr(out, F.lit(9), F.lit(2)), mark, F.substr(out, F.lit(6), F.lit(2)), mark, F.substr(out, F.lit(1), F.lit(4)))
    return F.coalesce(F.when(first, out).otherwise(turned), text)


def _mail(text: Column, key: str) -> Column:
    at = F.instr(text, "@")
    return F.concat(_mixed(F.substr(text, F.lit(1), at - 1), key, "mail"), F.substr(text, at))


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one finding; what proves no valid number or date stays."""

    def whole(kind: str) -> Column:
        return found.rlike(f"^(?:{KINDS[kind]})$")

    return (
        F.when(F.instr(found, "@") > 1, _mail(found, key))
        .when(whole("date") | whole("day_first"), _date(found, key))
        .when(whole("address"), _address(found, key))
        .when(whole("social"), _social(found, key))
        .when(whole("phone") | whole("bare_phone"), _phone(found, key))
        .when(whole("card"), _card(found, key))
        .otherwise(_mixed(found, key, "secret"))
    )


def _hidden(found: Column, before: Column, key: str) -> Column:
    """The pseudonym of a finding after ``before``. A secret by name never stays, valid as a number or not."""
    secret = F.right(before, F.lit(LEAD_LENGTH)).rlike(LEAD)
    return F.element_at(
        F.transform(F.array(pseudonym(found, key)), lambda p: F.when(secret & (p == found), _mixed(found, key, "secret")).otherwise(p)), 1
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms under ``key`` in the text, and n_found: the findings looked at.

    Whoever knows the key can turn pseudonyms back, so there is none by default.
    Found are mail addresses, secrets after a fixed name in any case and = or :, or after bearer, dates, network addresses,
    social security, phone and card numbers. Numbers and dates that are not valid stay, unless they are secrets by name.
    Not found are foreign phone numbers, bank accounts, long network addresses and dates without leading zeros. Null text stays
    null with 0 found. An input column n_found is replaced, all others stay. Equal texts stay equal, repeated rows stay
    as many. No rows give no rows.
    """
    rest = docs.drop("n_found")
    found = F.when(F.col(text).rlike(ANY), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    looked = rest.select(F.struct("*").alias("rest"), found.alias("found"))
    text_before = looked["rest"][text]
    # What stands around the findings: one part more than these.
    around = F.split(text_before, ANY, -1)
    parts = F.transform(F.array(around), lambda a: F.zip_with(
        a, F.concat(F.zip_with("found", F.slice(a, F.lit(1), F.size("found")), lambda m, b: _hidden(m, b, key)), F.array(F.lit(""))),
        lambda x, y: F.concat(x, y),
    ))
    new = F.when(F.col("found").isNull(), text_before).otherwise(F.array_join(F.element_at(parts, 1), ""))
    return looked.select(
        *[new.alias(c) if c == text else F.col("rest")[c].alias(c) for c in rest.columns],
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_found"),
    )
