"""What an order says, parsed: type of transfer, date, share, document kind."""

from __future__ import annotations

import re

from landledger import fixed
from landledger.functions.text import heading_skeleton, let, pattern, quoted, trim


def bare(word: str) -> str:
    """The heading skeleton of a constant."""
    return re.sub(f"[{fixed.MARKS}{fixed.BLANKS}{fixed.DASHES}:·.|]", "", word.lower())


def parse_mutation_type(value: str) -> str:
    """Kind of transfer from the first words of a text; the longest known word is tried first."""
    words = sorted(((bare(w), kind) for w, kind in fixed.TRANSFER_WORDS), key=lambda p: -len(p[0]))
    whens = " ".join(f"when startswith(w, {quoted(word)}) then '{kind}'" for word, kind in words)
    return let(heading_skeleton(value), "w", f"case {whens} end")


def parse_order_date(value: str) -> str:
    """D/M/YYYY with slashes, dots or dashes; impossible dates are null."""
    regex = "^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})\\z"

    def part(group: int) -> str:
        return f"regexp_extract(t, {pattern(regex)}, {group})"

    text = f"concat({part(3)}, '-', lpad({part(2)}, 2, '0'), '-', lpad({part(1)}, 2, '0'))"
    # Years before 100 are read as 19xx where the date is built, so they never match.
    return let(
        trim(value), "t",
        f"if(rlike(t, {pattern(regex)}) and {part(3)} >= '0100', try_to_date({text}, 'yyyy-MM-dd'), null)",
    )


def heading_kind(heading: str) -> str:
    """MUTATION_ORDER or KHATAUNI from the text of the first lines."""
    marks = " or ".join(f"contains(w, {quoted(bare(m))})" for m in fixed.ORDER_MARKERS)
    return let(heading_skeleton(heading), "w", f"if({marks}, 'MUTATION_ORDER', 'KHATAUNI')")


def heading_known(heading: str) -> str:
    """Whether any known heading was found."""
    marks = " or ".join(f"contains(w, {quoted(bare(m))})" for m in fixed.ORDER_MARKERS + fixed.RECORD_MARKERS)
    return let(heading_skeleton(heading), "w", marks)
