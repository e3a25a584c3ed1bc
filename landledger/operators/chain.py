"""Chain of title: replay of an ownership register.

Register-order checks (dates, numbers) are windows and joins. Only the replay, where
every entry changes who may make the next one, is Python: it streams the sorted
entries of a parcel past a small state and gathers at most one day of a parcel.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.names import names_agree
from landledger.functions.ordered import BLOCK_ROWS, scan_sorted, union_all, with_greatest_before, with_position
from landledger.functions.shares import exceeds, minus, plus, read_share, shown
from landledger.functions.text import day_label, name_key, quoted
from landledger.operators.findings import filled_text, gather, finding
from landledger.operators.places import fuzzy_place_join, with_keys
from landledger.session import settle, stored

REGISTER_FINDING = (
    "parcel_id bigint, phase int, ord bigint, seq int, kind string, severity string, "
    "code string, params map<string,string>, issue string"
)


# --- which entries stand, and where --------------------------------------

def replaced_entries(mutations: DataFrame) -> DataFrame:
    """Entries named by a later correction; kept as history, never replayed."""
    named = mutations.filter("supersedes_id is not null").selectExpr("parcel_id", "supersedes_id as id").distinct()
    return mutations.join(named, ["parcel_id", "id"], "left_semi")


def _followed(jumps: DataFrame) -> DataFrame:
    """``jumps`` (parcel_id, id, at, done) with ``at`` as far as it leads; rows that never end are not done.

    Every round doubles how far all rows see, so a line of n links takes log2(n) rounds, each a
    join on single entries. A walk that has taken more links than its parcel has is in a ring.
    """
    open_ = jumps.filter("not done").groupBy("parcel_id").agg(F.count("*").alias("n"))
    longest, reach = open_.agg(F.max("n")).first()[0] or 0, 1
    while longest and reach <= longest:
        further = jumps.selectExpr("parcel_id", "id as at", "at as further", "done as ends")
        jumps = settle(
            jumps.filter("not done").join(further, ["parcel_id", "at"]).selectExpr("parcel_id", "id", "further as at", "ends as done")
            .unionByName(jumps.filter("done"))
        )
        reach *= 2
        if jumps.filter("not done").isEmpty():
            break
    return jumps


def correction_position(mutations: DataFrame) -> DataFrame:
    """id -> place of the original entry a correction goes back to, for corrections only.

    The links double in reach from round to round. Where a correction names an entry that
    is not there, the last entry of the line gives the place. In a ring of corrections every
    entry keeps its own place; a line that runs into a ring goes once round it, so it
    takes the place of the entry before the one it came in at.
    """
    return _positions(stored(mutations.select("parcel_id", "id", "seq", "supersedes_id")))


def _positions(mutations: DataFrame) -> DataFrame:
    corrections = mutations.filter("supersedes_id is not null").select("parcel_id", "id", "supersedes_id").distinct()
    named = corrections.selectExpr("parcel_id", "supersedes_id as id").distinct()
    # Few entries are corrections or named by one; the rest of a register is looked at once.
    involved = settle(
        mutations.select("parcel_id", "id", "seq")
        .join(corrections.select("parcel_id", "id").unionByName(named).distinct(), ["parcel_id", "id"], "left_semi")
    )
    links = corrections.join(
        involved.select("parcel_id", F.col("id").alias("supersedes_id")), ["parcel_id", "supersedes_id"], "left_semi"
    )
    onward = links.selectExpr("parcel_id", "id as at", "true as goes_on").distinct()
    jumps = settle(
        links.withColumnRenamed("supersedes_id", "at").join(onward, ["parcel_id", "at"], "left")
        .selectExpr("parcel_id", "id", "at", "goes_on is null as done")
    )
    ends = _followed(jumps)
    roots = ends.filter("done").selectExpr("parcel_id", "id", "at as root")
    rings = ends.filter("not done").selectExpr("parcel_id", "at as id").distinct()
    if not rings.isEmpty():
        rings = settle(rings)
        inside = jumps.join(rings, ["parcel_id", "id"], "left_semi")
        into = ends.filter("not done").select("parcel_id", "id").join(rings, ["parcel_id", "id"], "left_anti")
        entered = jumps.join(into, ["parcel_id", "id"], "left_semi").drop("done").join(
            rings.selectExpr("parcel_id", "id as at", "true as in_ring"), ["parcel_id", "at"], "left"
        ).selectExpr("parcel_id", "id", "at", "in_ring is not null as done")
        before = inside.selectExpr("parcel_id", "at", "id as root")
        roots = union_all([
            roots, rings.selectExpr("parcel_id", "id", "id as root"),
            _followed(settle(entered)).join(before, ["parcel_id", "at"]).select("parcel_id", "id", "root"),
        ])
    # An id may be in a register more than once; its place is one all the same.
    places = involved.groupBy("parcel_id", F.col("id").alias("root")).agg(F.min("seq").alias("position"))
    return (
        corrections.join(roots, ["parcel_id", "id"], "left").withColumn("root", F.coalesce("root", "id"))
        .join(places, ["parcel_id", "root"]).select("parcel_id", "id", "position")
    )


def standing_entries(mutations: DataFrame) -> DataFrame:
    """Entries not replaced by a correction, a correction standing in its original's place."""
    # Read several times by few columns, while working a register out may take shuffles of all entries.
    mutations = stored(mutations)
    named = mutations.filter("supersedes_id is not null").selectExpr("parcel_id", "supersedes_id as id").distinct()
    positions = _positions(mutations)
    return (
        mutations.join(named, ["parcel_id", "id"], "left_anti")
        .join(positions, ["parcel_id", "id"], "left")
        .withColumn("seq", F.expr("coalesce(position, seq)"))
        .drop("position")
    )


def ownership_history(mutations: DataFrame) -> DataFrame:
    """Standing entries of each parcel with their place by date, then register order."""
    named = mutations.filter("supersedes_id is not null").selectExpr("parcel_id", "supersedes_id as id").distinct()
    standing = mutations.join(named, ["parcel_id", "id"], "left_anti")
    return with_position(
        standing, ["parcel_id"], ["effective_date", "seq", "id"], "year(effective_date)", "place"
    )


# --- checks in register order --------------------------------------------

def _register_finding(phase: int, code: str, params: dict, shown_as: dict, order: str = "seq") -> list[str]:
    packed = ", ".join(f"{quoted(k)}, cast({v} as string)" for k, v in params.items())
    return [
        "parcel_id", f"{phase} as phase", f"cast({order} as bigint) as ord", "seq", f"'{code}' as kind",
        f"'{fixed.SEVERITY[code]}' as severity", f"'{code}' as code",
        f"cast(map({packed}) as map<string,string>) as params",
        filled_text(fixed.TEXTS[code], {**params, **shown_as}) + " as issue",
    ]


def backdated(standing: DataFrame) -> DataFrame:
    """Entries dated before an entry registered ahead of them.

    The running latest date is kept per block of register places, so that one long
    register is spread over tasks; the first entry of the latest date is cited.
    """
    latest = with_greatest_before(
        standing, ["parcel_id"], ["seq", "id"], f"seq div {BLOCK_ROWS}",
        F.expr("struct(effective_date as day, -seq as neg)"), "latest",
    )
    params = {"seq": "seq", "date": "effective_date", "prevSeq": "-latest.neg", "prevDate": "latest.day"}
    texts = {"date": day_label("effective_date"), "prevDate": day_label("latest.day")}
    return latest.filter("effective_date < latest.day").selectExpr(*_register_finding(1, "backdated", params, texts))


def future_dated(standing: DataFrame, now: str) -> DataFrame:
    """Entries dated more than a day ahead of now."""
    late = standing.filter(f"timestamp(effective_date) > timestamp'{now}' + interval 1 day")
    params = {"seq": "seq", "date": "effective_date"}
    return late.selectExpr(*_register_finding(1, "futureDated", params, {"date": day_label("effective_date")}))


def duplicate_numbers(standing: DataFrame) -> DataFrame:
    """Entries repeating a mutation number, citing the first entry that carries it.

    Entries of one place and id count one by one: all but one of those that come first repeat it.
    """
    numbered = standing.filter("mutation_number <> ''").groupBy("parcel_id", "mutation_number", "seq", "id").agg(
        F.count("*").alias("copies")
    )
    first = (
        numbered.groupBy("parcel_id", "mutation_number")
        .agg(F.min(F.struct("seq", "id")).alias("first"), F.sum("copies").alias("n"))
        .filter("n > 1")
    )
    again = (
        numbered.join(first, ["parcel_id", "mutation_number"])
        .withColumn("repeats", F.expr("copies - int(struct(seq, id) <=> first)")).filter("repeats > 0")
        .withColumn("repeat", F.expr("explode(sequence(1L, repeats))"))
    )
    params = {"number": "mutation_number", "first": "first.seq", "second": "seq"}
    return again.selectExpr(*_register_finding(2, "duplicateNumber", params, {}))


def arrival_findings(arrivals: DataFrame, standing: DataFrame, now: str) -> DataFrame:
    """Register-order findings of entries that would each be the last of a register.

    ``arrivals`` has parcel_id (what the findings are filed under), of_parcel (the
    register, may be null), seq, effective_date and mutation_number. A last entry changes
    nothing for those ahead of it, so it is only held against a summary of the register.
    """
    latest = standing.groupBy(F.col("parcel_id").alias("of_parcel")).agg(
        F.expr("max(struct(effective_date as day, -seq as neg)) as latest")
    )
    numbers = standing.filter("mutation_number <> ''").groupBy(
        F.col("parcel_id").alias("of_parcel"), "mutation_number"
    ).agg(F.expr("struct(min(seq) as seq) as first"))
    params = {"seq": "seq", "date": "effective_date", "prevSeq": "-latest.neg", "prevDate": "latest.day"}
    texts = {"date": day_label("effective_date"), "prevDate": day_label("latest.day")}
    early = arrivals.join(latest, "of_parcel").filter("effective_date < latest.day")
    again = arrivals.join(numbers, ["of_parcel", "mutation_number"])
    number = {"number": "mutation_number", "first": "first.seq", "second": "seq"}
    return union_all([
        early.selectExpr(*_register_finding(1, "backdated", params, texts)),
        future_dated(arrivals, now),
        again.selectExpr(*_register_finding(2, "duplicateNumber", number, {})),
    ])


# --- the replay ----------------------------------------------------------

_PUNCTUATION = re.compile("[.,;:'\"()\\[\\]/\\\\-]")
_BLANKS = re.compile(f"[{fixed.BLANKS}]+")
_MARKS = re.compile(f"[{fixed.MARKS}]")
_DROPPED = frozenset(fixed.HONORIFICS)


@lru_cache(65536)
def _key(name: str) -> tuple[str, ...]:
    words = _BLANKS.split(_PUNCTUATION.sub(" ", name.lower()))
    return tuple(_MARKS.sub("", w) for w in words if w and w not in _DROPPED)


@lru_cache(65536)
def _closeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return max(0.0, 1.0 - row[-1] / max(len(a), len(b)))


@lru_cache(65536)
def same_person(a: str, b: str) -> bool:
    """Whether two names are the same person; the rule of ``compare_names``."""
    left, right = _key(a), _key(b)
    if not left or not right:
        return False
    if left == right:
        return True
    short, long = (left, right) if len(left) <= len(right) else (right, left)
    free, matched = list(range(len(long))), 0.0
    for word in short:
        best = max(free, key=lambda i: (_closeness(word, long[i]), -i), default=None)
        if best is not None and _closeness(word, long[best]) >= fixed.TOKEN_MATCH:
            free.remove(best)
            matched += _closeness(word, long[best])
    return matched / len(long) >= fixed.NAME_SAME


def _day(d: date) -> str:
    month = "Jan Feb Mar Apr May Jun Jul Aug Sept Oct Nov Dec".split()[d.month - 1]
    return f"{d.day} {month} {d.year}"


_PLACEHOLDER = re.compile(r"\{(\w+)\}")


class Book:
    """What stands at a point of a register: holders, who died, who sold out, what was settled today.

    Every map goes from a key to (number, name, ...); numbers rise in the order things came
    in, which is the order they are looked through.
    """

    MAPS = ("holders", "died", "left", "settled", "over")

    def __init__(self) -> None:
        self.maps: dict[str, dict] = {m: {} for m in self.MAPS}
        self.clock = 0
        self.journal: list[tuple] | None = None

    def number(self) -> int:
        self.clock += 1
        return self.clock

    def get(self, which: str, key):
        return self.maps[which].get(key)

    def set(self, which: str, key, value: tuple | None) -> None:
        held = self.maps[which]
        if self.journal is not None:
            self.journal.append((which, key, held.get(key), value))
        if value is None:
            held.pop(key, None)
        else:
            held[key] = value

    def find(self, which: str, name: str):
        """The first entry whose name is the same person."""
        return next((v for v in self.maps[which].values() if same_person(v[1], name)), None)

    def credit(self, name: str, share, since: date) -> None:
        held = self.find("holders", name)
        number, owner, had, day = held or (self.number(), name, (0, 1), since)
        self.set("holders", number, (number, owner, plus(had, share), day))

    def note(self, which: str, name: str, *what) -> None:
        before = self.get(which, name)
        self.set(which, name, (before[0] if before else self.number(), name, *what))


class Fork(Book):
    """A book that differs from another one in a few places, and follows it everywhere else."""

    def __init__(self, base: Book, document_id: int):
        self.base, self.document_id = base, document_id
        self.changed: dict[str, dict] = {m: {} for m in self.MAPS}
        #: Names that it may see otherwise than the base does.
        self.names: set[str] = set()

    def number(self) -> int:
        return self.base.number()

    def get(self, which: str, key):
        own = self.changed[which]
        return own[key] if key in own else self.base.get(which, key)

    def set(self, which: str, key, value: tuple | None) -> None:
        self.names |= {v[1] for v in (value, self.get(which, key)) if v}
        self.changed[which][key] = value

    def keep(self, which: str, key, before: tuple | None, after: tuple | None) -> None:
        """The base has changed where this one has not; it stays as it was."""
        if key not in self.changed[which]:
            self.names |= {v[1] for v in (before, after) if v}
            self.changed[which][key] = before

    def find(self, which: str, name: str):
        own = self.changed[which]
        place = 0 if which == "holders" else 1
        best = next((v for v in self.base.maps[which].values() if v[place] not in own and same_person(v[1], name)), None)
        for v in own.values():
            if v and (best is None or v[0] < best[0]) and same_person(v[1], name):
                best = v
        return best


class Register:
    """State of one parcel while its standing entries pass by in (date, seq) order.

    Rows: parcel_id, date, seq, id, type, from_owner, to_owner, share. Yields tuples of
    REPLAY. Entries of one day are taken together, because all heirs of one death are
    settled with the first of them.
    """

    def __init__(self, parcel_id: int, steps: bool):
        self.parcel_id, self.steps = parcel_id, steps
        self.today: list[tuple] = []
        self.book = Book()
        self.ord = 0
        self.first: date | None = None
        self.last: date | None = None

    def feed(self, row: tuple):
        if self.today and row[1] != self.today[0][1]:
            yield from self._settle_day()
        self.today.append(row)

    def finish(self):
        if self.today:
            yield from self._settle_day()
        if self.first is None:
            return
        total = self._total()
        if exceeds(total, (1, 1)) > 0 and not self.book.get("over", ""):
            yield self._finding(self.book, "sharesExceedWhole", None, {"total": shown(total)}, code="sharesExceedWholeTotal")
        now = self._held()
        years = int((self.last - self.first).days / 365.25 * 10 + 0.5) / 10
        yield (self.parcel_id, "end", self.ord, None, None, None, None, None, None, None, now, self.first, self.last, years)

    def _total(self):
        total = (0, 1)
        for h in self.book.maps["holders"].values():
            total = plus(total, h[2])
        return total

    def _held(self):
        return [{"owner": o, "share": shown(s), "since": d} for _, o, s, d in self.book.maps["holders"].values() if s[0]]

    def _finding(self, book: Book, kind: str, seq, params: dict, texts: dict | None = None, code: str | None = None):
        if kind == "sharesExceedWhole":
            book.set("over", "", (0, ""))
        params = {k: str(v) for k, v in params.items()}
        said = {**params, **(texts or {})}
        issue = _PLACEHOLDER.sub(lambda m: said[m[1]], fixed.TEXTS[code or kind])
        self.ord += 1
        return (
            self.parcel_id, "finding", self.ord, seq, kind, fixed.SEVERITY[kind], code or kind,
            list(params.items()), issue, None, None, None, None, None,
        )

    def _step(self, row: tuple, applied: bool):
        if self.steps:
            self.ord += 1
            yield (
                self.parcel_id, "step", self.ord, row[2], None, None, None, None, None, applied,
                self._held(), row[1], None, None,
            )

    def _settle_day(self):
        rows, self.today = self.today, []
        day = rows[0][1]
        self.last = day
        if self.first is None:
            self.first = day
            yield from self._open(self.book, rows)
        self.book.maps["settled"].clear()
        for row in rows:
            found, applied = self._apply(self.book, row, day, rows)
            yield from found
            yield from self._step(row, applied)

    def _open(self, book: Book, rows: list[tuple]):
        """A history that begins with a transfer: the seller is presumed to have held it."""
        _, day, seq, _, kind, giver, _, share = rows[0][:8]
        if kind == "ORIGINAL" or not giver:
            return
        if kind == "INHERITANCE":
            opening = (0, 1)
            for heir in heirs_of(giver, rows):
                opening = plus(opening, read_share(heir[7]) or (0, 1))
        else:
            opening = read_share(share)
        if opening and opening[0]:
            number = book.number()
            book.set("holders", number, (number, giver, opening, day))
            yield self._finding(
                book, "titleNotTraced", seq, {"type": kind, "from": giver},
                {"type": fixed.TRANSFER_LABELS[kind].lower()},
            )

    def _apply(self, book: Book, row: tuple, day: date, rows: list[tuple]) -> tuple[list[tuple], bool]:
        """Findings of an entry, and whether it took effect. ``rows`` are the entries of its day."""
        _, _, seq, _, kind, giver, taker, text = row[:8]
        share = read_share(text)
        if share is None:
            return [self._finding(book, "unreadableShare", seq, {"seq": seq, "share": text or ""})], False
        if kind == "ORIGINAL":
            book.credit(taker, share, day)
            return [], True
        if not giver:
            return [self._finding(
                book, "missingTransferor", seq, {"seq": seq, "type": kind},
                {"type": fixed.TRANSFER_LABELS[kind].lower()},
            )], False
        if kind == "INHERITANCE" and book.get("settled", giver):
            return [], True

        holder = book.find("holders", giver)
        said = {"from": giver, "share": text, "date": day.isoformat()}
        if holder is None:
            return [self._no_title(book, seq, giver, taker, said, day)], False
        number, owner, held, since = holder

        if kind == "INHERITANCE":
            found = []
            book.note("settled", giver)
            heirs = [(h[6], read_share(h[7]) or (0, 1)) for h in heirs_of(giver, rows)]
            total = (0, 1)
            for _, part in heirs:
                total = plus(total, part)
            if exceeds(total, held) > 0:
                found.append(self._finding(
                    book, "sharesExceedWhole", seq,
                    {"from": giver, "date": day.isoformat(), "total": shown(total), "held": shown(held)},
                    {"date": _day(day)},
                ))
            elif exceeds(total, held) < 0:
                found.append(self._finding(
                    book, "undistributed", seq,
                    {"from": giver, "total": shown(total), "held": shown(held), "left": shown(minus(held, total))},
                ))
            book.set("holders", number, None)
            book.note("died", giver, day)
            for heir, part in heirs:
                book.credit(heir, part, day)
            return found, True

        if exceeds(share, held) > 0:
            return [self._finding(
                book, "overTransfer", seq,
                {"from": giver, "share": text, "to": taker, "date": day.isoformat(), "held": shown(held)},
                {"date": _day(day)},
            )], False
        rest = minus(held, share)
        book.set("holders", number, (number, owner, rest, since) if rest[0] else None)
        if not rest[0]:
            book.note("left", giver, day, taker)
        book.credit(taker, share, day)
        return [], True

    def _no_title(self, book: Book, seq, giver: str, taker: str, said: dict, day: date):
        """Why someone who holds nothing cannot transfer: died, sold already, or never held."""
        if died := book.find("died", giver):
            return self._finding(
                book, "deceasedTransferor", seq, {**said, "diedDate": died[2].isoformat()},
                {"date": _day(day), "diedDate": _day(died[2])},
            )
        if sold := book.find("left", giver):
            _, _, when, to = sold
            return self._finding(
                book, "doubleSale", seq,
                {"from": giver, "share": said["share"], "to": taker, "date": said["date"],
                 "earlierTo": to, "earlierDate": when.isoformat()},
                {"date": _day(day), "earlierDate": _day(when)},
            )
        return self._finding(book, "chainBreak", seq, said, {"date": _day(day)})


def heirs_of(giver: str, rows: list[tuple]) -> list[tuple]:
    return [r for r in rows if r[4] == "INHERITANCE" and r[5] == giver]


class Previews(Register):
    """A register and, in the same pass, how it would stand with each of some proposed entries.

    Rows have the document of a proposed entry last (null for entries that stand) and come
    after those that stand on the same day. A proposed entry forks the state at its place. A fork
    holds what differs from the register as it stands, and takes part in later entries only where these name
    someone it may see differently; everything else it shares. Findings of forks come as
    rows of kind ``fork`` with the document.
    """

    def __init__(self, key: tuple):
        super().__init__(key[0], False)
        self.forks: list[Fork] = []
        #: Names that forks see differently, and which forks.
        self.seen: dict[str, list[Fork]] = {}
        self.listed: dict[int, set[str]] = {}

    def feed(self, row: tuple):
        # The second key tells orders without a register apart.
        yield from ((*r, None) if len(r) == 14 else r for r in super().feed((row[0], *row[2:])))

    def finish(self):
        if self.today:
            yield from self._settle_day()
        base = self._total()
        for fork in self.forks:
            total = base
            for key, value in fork.changed["holders"].items():
                had = self.book.get("holders", key)
                total = minus(plus(total, value[2] if value else (0, 1)), had[2] if had else (0, 1))
            if exceeds(total, (1, 1)) > 0 and not fork.get("over", ""):
                yield self._of(fork, self._finding(fork, "sharesExceedWhole", None, {"total": shown(total)}, code="sharesExceedWholeTotal"))
        yield from ((*r, None) for r in super().finish())

    @staticmethod
    def _of(fork: Fork, finding: tuple) -> tuple:
        return (finding[0], "fork", *finding[2:], fork.document_id)

    def _list(self, forks: Iterable[Fork]) -> None:
        for fork in forks:
            known = self.listed.setdefault(id(fork), set())
            for name in fork.names - known:
                self.seen.setdefault(name, []).append(fork)
            known |= fork.names

    def _concerned(self, names: set[str]) -> dict[int, Fork]:
        return {id(f): f for seen, forks in self.seen.items() if any(same_person(seen, n) for n in names) for f in forks}

    def _settle_day(self):
        today, self.today = self.today, []
        day = today[0][1]
        rows = [r for r in today if r[8] is None]
        proposed = [(r, Fork(self.book, r[8])) for r in today if r[8] is not None]
        self.book.maps["settled"].clear()
        for fork in self.forks:
            fork.changed["settled"].clear()
        if rows:
            self.last = day
        if rows and self.first is None:
            self.first = day
            # Forks of earlier days have begun otherwise, and those that add an heir begin with other shares.
            own = [(r, f) for r, f in proposed if joins(r, rows[0])]
            for r, fork in own:
                yield from (self._of(fork, x) for x in self._open(fork, [*rows, r]))
            yield from self._in_base(lambda: self._open(self.book, rows), [*self.forks, *(f for _, f in own)])
        elif self.first is None:
            for r, fork in proposed:
                yield from (self._of(fork, x) for x in self._open(fork, [r]))
        self._list([*self.forks, *(f for _, f in proposed)])
        with_own = {id(f): [*rows, r] for r, f in proposed}
        for row in rows:
            names = {n for n in (row[5], row[6]) if n}
            if row[4] == "INHERITANCE" and row[5]:
                names |= {h[6] for h in heirs_of(row[5], rows) if h[6]}
            concerned = self._concerned(names) if self.seen else {}
            concerned |= {id(f): f for r, f in proposed if joins(r, row)}
            for fork in concerned.values():
                found, _ = self._apply(fork, row, day, with_own.get(id(fork), rows))
                yield from (self._of(fork, x) for x in found)
            yield from self._in_base(lambda: self._apply(self.book, row, day, rows)[0], concerned.values())
        for r, fork in proposed:
            found, _ = self._apply(fork, r, day, [*rows, r])
            yield from (self._of(fork, x) for x in found)
        self.forks += [f for _, f in proposed]
        self._list(f for _, f in proposed)

    def _in_base(self, change, concerned: Iterable[Fork]):
        """Let the register change, and keep the forks concerned as they have made up their minds."""
        self.book.journal = []
        yield from ((*x, None) for x in change())
        journal, self.book.journal = self.book.journal, None
        for fork in concerned:
            for change_ in journal:
                fork.keep(*change_)
        self._list(concerned)


def joins(proposed: tuple, row: tuple) -> bool:
    """Whether a proposed entry is one more heir of the same death."""
    return proposed[4] == row[4] == "INHERITANCE" and proposed[5] == row[5]


REPLAY = (
    "parcel_id bigint, row_kind string, ord bigint, seq int, kind string, severity string, code string, "
    "params map<string,string>, issue string, applied boolean, "
    "holders array<struct<owner:string,share:string,since:date>>, first_day date, last_day date, years double"
)


def chain_replay(standing: DataFrame, steps: bool = False) -> DataFrame:
    """Replay every register. Rows of kind finding, step (on demand) and end, one per parcel."""
    rows = standing.select(
        "parcel_id", "effective_date", F.col("seq").cast("int").alias("seq"), "id", "type",
        "from_owner", "to_owner", "share",
    )
    return scan_sorted(
        rows, ["parcel_id"], ["effective_date", "seq", "id"], lambda key: Register(key[0], steps), REPLAY
    )


def forked_replay(standing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Replay every register for which something is proposed once, with all of it. REPLAY and document_id.

    ``proposed`` has parcel_id (null where there is no register) and document_id besides the
    columns of an entry. Rows of kind finding are of the register as it stands, rows of kind
    fork of what would be found in it and with the entry that the document proposes, where
    the two may differ.
    """
    columns = ["effective_date", "seq", "id", "type", "from_owner", "to_owner", "share", "document_id"]
    rows = standing.withColumn("document_id", F.lit(None).cast("long")).withColumn("alone", F.lit(None).cast("long")).unionByName(
        proposed.withColumn("alone", F.expr("if(parcel_id is null, document_id, null)")), allowMissingColumns=True
    )
    return scan_sorted(
        rows.select("parcel_id", "alone", *columns).withColumn("seq", F.col("seq").cast("int")), ["parcel_id", "alone"],
        ["effective_date", F.col("document_id").isNotNull(), "seq", "id", "document_id"], Previews, f"{REPLAY}, document_id bigint",
        only_with=F.col("document_id").isNotNull(),
    )


def replay_findings(replay: DataFrame) -> DataFrame:
    return replay.filter("row_kind = 'finding'").select(
        "parcel_id", F.lit(3).alias("phase"), "ord", "seq", "kind", "severity", "code", "params", "issue"
    )


def holders_current(replay: DataFrame) -> DataFrame:
    """Who holds what after the last entry, in the order they came in."""
    return (
        replay.filter("row_kind = 'end'")
        .select("parcel_id", F.posexplode("holders").alias("place", "h"))
        .select("parcel_id", "place", "h.owner", "h.share", "h.since")
    )


def holder_steps(standing: DataFrame) -> DataFrame:
    """Who holds what after each entry, whether the entry was applied or not."""
    return chain_replay(standing, steps=True).filter("row_kind = 'step'").select(
        "parcel_id", "ord", "seq", "applied", F.col("first_day").alias("effective_date"), "holders"
    )


def chain_span(standing: DataFrame) -> DataFrame:
    """First and last date of each register and the years between, to one decimal."""
    return standing.groupBy("parcel_id").agg(
        F.min("effective_date").alias("first_day"), F.max("effective_date").alias("last_day")
    ).withColumn("years", F.expr("floor(datediff(last_day, first_day) / 365.25D * 10D + 0.5D) / 10D"))


def register_findings(standing: DataFrame, now: str) -> DataFrame:
    """Findings that follow from register order alone."""
    return union_all([backdated(standing), future_dated(standing, now), duplicate_numbers(standing)])


def chain_findings(standing: DataFrame, now: str, replay: DataFrame | None = None) -> DataFrame:
    replay = chain_replay(standing) if replay is None else replay
    return register_findings(standing, now).unionByName(replay_findings(replay))


# --- records against their chain -----------------------------------------

def parcel_history(records: DataFrame, parcels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """document_id -> the parcel the record describes; the smallest id where several match."""
    left = with_keys(records.filter("village <> '' and district <> ''")).select(
        "document_id", "khasra_trim", "village_key", "district_key"
    )
    right = (
        with_keys(parcels).groupBy("khasra_trim", "village_key", "district_key")
        .agg(F.min("parcel_id").alias("parcel_id"))
    )
    return (
        fuzzy_place_join(left, right, "khasra_trim", pairs)
        .groupBy("document_id").agg(F.min("parcel_id").alias("parcel_id"))
    )


def owner_vs_chain(owners: DataFrame, replay: DataFrame) -> DataFrame:
    """Compare the owner a record names with the holders its chain ends with.

    ``owners`` has document_id, parcel_id, owner_name. Holders arrive as one array per
    parcel, so no regrouping is needed. Columns: document_id, parcel_id, issues.
    """
    # A key is spelled out once a holder; put into the comparison it would be at each of its mentions.
    ends = replay.filter("row_kind = 'end' and size(holders) > 0").selectExpr(
        "parcel_id", "holders", f"transform(holders, h -> {name_key('h.owner')}) as holder_keys"
    )
    held = "array_join(transform({}, h -> concat(h.owner, ' (', h.share, ')')), ', ')"
    joined = (
        owners.filter("owner_name <> ''")
        .withColumn("owner_key", F.expr(name_key("owner_name")))
        .join(ends, "parcel_id")
        .withColumn("at", F.expr(f"array_position(transform(holder_keys, k -> {names_agree('owner_key', 'k')}), true)"))
        .withColumn("others", F.expr("filter(holders, (h, i) -> i + 1 <> at)"))
    )
    unrecorded = finding(
        "'owner_name'", "chainDefect", "unrecordedTransfer", {"owner": "owner_name", "head": held.format("holders")}
    )
    unlisted = finding(
        "'owner_name'", "chainWarning", "unlistedCoOwners",
        {"owner": "owner_name", "share": "element_at(holders, int(at)).share", "others": held.format("others")},
    )
    cases = gather(f"when at = 0 then {unrecorded} when size(others) > 0 then {unlisted}")
    return (
        joined.withColumn("issues", F.expr(cases)).filter("size(issues) > 0")
        .select("document_id", "parcel_id", "issues")
    )


def chain_status(parcels: DataFrame, standing: DataFrame, findings: DataFrame) -> DataFrame:
    """EMPTY, CLEAN or DEFECTS per parcel, with findings split by severity."""
    entries = standing.groupBy("parcel_id").agg(F.count("*").alias("entries"))
    found = findings.groupBy("parcel_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    return (
        parcels.select("parcel_id").join(entries, "parcel_id", "left").join(found, "parcel_id", "left")
        .selectExpr(
            "parcel_id", "coalesce(entries, 0L) as entries", "coalesce(critical, 0L) as critical",
            "coalesce(warnings, 0L) as warnings",
            "case when entries is null then 'EMPTY' when coalesce(critical, 0) + coalesce(warnings, 0) > 0 "
            "then 'DEFECTS' else 'CLEAN' end as chain_status",
        )
    )
