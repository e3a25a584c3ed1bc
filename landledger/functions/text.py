"""Text expressions: blanks, tokens, skeletons, numbers written as text.

Every function takes and returns SQL expression text, so a long composition reaches
the engine as one parsed expression.
"""

from __future__ import annotations

from landledger import fixed


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(regex: str) -> str:
    """A regular expression as a raw SQL literal."""
    return "r'" + regex.replace("'", "\\x27") + "'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


BLANK = f"[{fixed.BLANKS}]"
_PUNCTUATION = "[.,;:'\"()\\[\\]/\\\\-]"
_HONORIFICS = ", ".join(quoted(w) for w in fixed.HONORIFICS)


def replaced(value: str, regex: str, by: str = "") -> str:
    return f"regexp_replace({value}, {pattern(regex)}, {quoted(by)})"


def trim(value: str) -> str:
    """Trim every Unicode blank, not only U+0020."""
    return replaced(value, f"^{BLANK}+|{BLANK}+\\z")


def filled(value: str) -> str:
    """True when the text has anything but blanks; never null."""
    return f"coalesce(rlike({value}, {pattern(f'[^{fixed.BLANKS}]')}), false)"


def folded(value: str) -> str:
    """Trimmed lower case, empty when null."""
    return f"lower({trim(f'''coalesce({value}, '')''')})"


def skeleton(value: str) -> str:
    """Consonant skeleton of Devanagari text; other text is unchanged."""
    return replaced(value, f"[{fixed.MARKS}]")


def heading_skeleton(value: str) -> str:
    """Skeleton in lower case without blanks, dashes, colons, dots and bars."""
    return replaced(f"lower({value})", f"[{fixed.MARKS}{fixed.BLANKS}{fixed.DASHES}:·.|]")


def name_tokens(value: str) -> str:
    """Identifying words of a person or place name, in order."""
    spaced = replaced(f"lower(coalesce({value}, ''))", _PUNCTUATION, " ")
    return (
        f"filter(split({spaced}, {pattern(BLANK + '+')}), "
        f"t -> length(t) > 0 and t not in ({_HONORIFICS}))"
    )


def name_key(value: str) -> str:
    """Skeletons of the identifying words; all that name comparison looks at."""
    return f"transform({name_tokens(value)}, t -> {skeleton('t')})"


def place_key(value: str) -> str:
    """Skeleton of the identifying words of a place, joined by single spaces."""
    return skeleton(f"array_join({name_tokens(value)}, ' ')")


def mapped(value: str, pairs: dict, default: str = "null") -> str:
    """Look a value up in a small constant table with a CASE expression."""
    def lit(v) -> str:
        return quoted(v) if isinstance(v, str) else str(v)

    whens = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in pairs.items())
    return f"case {value} {whens} else {default} end"


def half_up(value: str) -> str:
    """Round to a whole number, halves up (also for negative numbers)."""
    return f"floor({value} + 0.5D)"


def half_up_at(value: str, places: int) -> str:
    """Round to ``places`` decimals, halves up."""
    scale = f"{10**places}.0D"
    return f"(floor({value} * {scale} + 0.5D) / {scale})"


def leading_number(value: str) -> str:
    """Number at the start of a text ("1.2 ha" is 1.2), null when there is none."""
    regex = f"^{BLANK}*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    return f"try_cast(regexp_extract({value}, {pattern(regex)}, 1) as double)"


def whole_number(value: str) -> str:
    """Number only if the entire text is one, else null."""
    regex = f"^{BLANK}*[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?{BLANK}*\\z"
    return f"case when rlike({value}, {pattern(regex)}) then try_cast({trim(value)} as double) end"


def number_text(value: str) -> str:
    """A double as people write it: plain digits, no trailing ".0"."""
    plain = replaced(replaced(f"cast(try_cast({value} as decimal(38,18)) as string)", "0+\\z"), "\\.\\z")
    return (
        f"case when {value} = 0 then '0' "
        f"when abs({value}) >= 1e-6D and abs({value}) < 1e19D then {plain} "
        f"else cast({value} as string) end"
    )


def iso_millis(value: str) -> str:
    """Timestamp as ISO text with milliseconds in UTC (session zone must be UTC)."""
    return f"date_format({value}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def day_label(day: str) -> str:
    """A date as "4 Sept 2026"."""
    months = "'Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sept','Oct','Nov','Dec'"
    return f"concat_ws(' ', dayofmonth({day}), elt(month({day}), {months}), year({day}))"
