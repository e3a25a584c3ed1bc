"""Fill-in-middle transformation: one match of repeated units says where a text can be cut.

A pattern ``(unit)*`` is matched against the whole text once; the regex library keeps every
repetition of the group, so the ends of the group are the places where units end. Their
number and both cut places come from that list. What is drawn per document (cut places,
form) comes from a hash of its id, so a lost task draws the same again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point, line feeds included.
CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred documents, those that are transformed, and of a hundred of these, those that begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Texts of this many bytes are given back at once.
BYTES = 8 << 20


def draws(doc_id: str | Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits: the first groups of eight digits of sha256 of ``seed``, a colon and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = CODE_POINT, seed: int = SEED,
    transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """All columns of ``docs`` and n, form, prefix_chars, middle_chars, output.

    ``n`` counts the units of the text. The prefix ends after the smaller of two drawn numbers
    of units (0 to n), the middle after the larger; ``output`` has the parts, each after its
    mark, as prefix, suffix, middle (form psm) or suffix, prefix, middle (spm). A text is left as it is
    (plain, with null lengths) if it is empty, has one of the marks, or is not drawn.

    ``unit`` must match every text to its end, one way only, for instance ``\\X`` for what a reader
    takes as one letter; a text it does not match whole is plain and has null n. Null text is
    empty. Repeated rows come out alike; a null id is drawn for like an empty one. Columns of
    the input with the names of new ones are replaced. No rows give no rows. A task holds
    the ends of one text at a time, some 100 bytes a unit.
    """
    whole = regex.compile(f"({unit})*")
    prefix, suffix, middle = marks
    kind = docs.schema[text].dataType.simpleString()
    news = ("n", "form", "prefix_chars", "middle_chars", "output")
    rest = [c for c in docs.columns if c.lower() not in news]
    places = {c: i for i, c in enumerate(rest)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw = list(zip(*(c.to_pylist() for c in batch.columns[len(rest):])))
            texts, start, size, rows = batch.column(places[text]), 0, 0, []
            for i, (h1, h2, h3, h4) in enumerate(draw):
                t = texts[i].as_py() or ""
                found = whole.fullmatch(t)
                ends = found.ends(1) if found and t else []
                n = len(ends)
                if not t or not n or h3 % 100 >= transformed or prefix in t or suffix in t or middle in t:
                    rows.append((n if found else None, "plain", None, None, t))
                else:
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = ends[a - 1] if a else 0, ends[b - 1] if b else 0
                    if h4 % 100 < suffix_first:
                        out, form = f"{suffix}{t[b:]}{prefix}{t[:a]}{middle}{t[a:b]}", "spm"
                    else:
                        out, form = f"{prefix}{t[:a]}{suffix}{t[b:]}{middle}{t[a:b]}", "psm"
                    rows.append((n, form, a, b - a, out))
                size += len(t)
                if size >= BYTES or i == len(draw) - 1:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                    own = batch.slice(start, i + 1 - start).columns[:len(rest)]
                    yield pa.RecordBatch.from_arrays([*own, *made], [*rest, *news])
                    start, size, rows = i + 1, 0, []

    if kind != "string":
        raise ValueError(f"{text} must be a string column")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields)
    # A name longer than all others clashes with none.
    own = "h" * max(map(len, docs.columns))
    drawn = docs.select(*[F.col(f"`{c}`") for c in rest], *[h.alias(f"{own}{i}") for i, h in enumerate(draws(doc_id, seed))])
    return drawn.mapInArrow(run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text, rebuilt from what ``fill_in_middle`` made of it and its form."""
    # A transformed text has no mark of its own, so every mark is a border.
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks))
    first, second, last = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(F.col(form) == "psm", F.concat(first, last, second)).when(F.col(form) == "spm", F.concat(second, last, first)).otherwise(F.col(output))
