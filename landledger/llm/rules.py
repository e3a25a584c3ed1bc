"""Line-first cleaning: punctuation, navigation and boilerplate rules per line, then the text's loss.

A line that breaks a rule goes; a document that loses too many of its words goes with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

# What is counted in a text.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
REPEAT = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20

# What the rules for lines look for.
MARKS = ".!?:;,…。！？\"')]»”।॥؟؛،۔"
BARS = (" | ", " > ", " » ", " • ", " · ")
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service", "we use cookies",
    "accept cookies", "accept all cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "click here to",
    "back to top", "share on facebook", "share on twitter", "subscribe to our newsletter",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "wir verwenden cookies", "cookies akzeptieren",
    "newsletter abonnieren", "nach oben", "tous droits réservés", "politique de confidentialité", "conditions d'utilisation",
    "nous utilisons des cookies", "accepter les cookies", "haut de page", "abonnez-vous à notre newsletter",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "condiciones de uso", "utilizamos cookies",
    "aceptar cookies", "volver arriba", "suscríbete a nuestro boletín",
)
#: Words from which on a line needs no mark at its end.
LONG_LINE = 5
#: Bars from which on a line of at most so many words between them is navigation.
LEAST_BARS, BAR_WORDS = 3, 4
#: Symbols per hundred words above which a line fails.
SYMBOL_PERCENT = 40
#: Per cent of the words that the remaining lines must hold.
KEPT_PERCENT = 50


def repeated_words(words: list[str], width: int = REPEAT) -> int:
    """Words in windows of ``width`` words that are found twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), "int64", len(words))
    # Windows get numbers that are equal where their words are, one word longer each time.
    window = ids[:n]
    for i in range(1, width):
        _, window = np.unique(window * len(numbers) + ids[i:n + i], return_inverse=True)
    edge = np.zeros(len(words) + 1, "int64")
    twice = (np.bincount(window) > 1)[window]
    edge[:n] += twice
    edge[width:width + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def line_fails(line: str, words: int) -> bool:
    """The line breaks a rule; ``words`` is how many it has. Lines without words break none."""
    if not words:
        return False
    if words < LONG_LINE and line.rstrip(" \t\n\x0b\x0c\r")[-1] not in MARKS:
        return True
    if sum(map(line.count, SYMBOLS)) * 100 > words * SYMBOL_PERCENT:
        return True
    bars = sum(map(line.count, BARS))
    if bars >= LEAST_BARS and words <= (bars + 1) * (BAR_WORDS + 1):
        return True
    low = line.lower()
    return any(phrase in low for phrase in BOILERPLATE)


def judged(text: str) -> tuple:
    """The base counts, base_failed, kept, and the text of the lines that stay."""
    words, lines = WORD.findall(text), text.split("\n")
    seen, again, lost, stay = set(), 0, 0, []
    for line in lines:
        n = len(WORD.findall(line))
        if n:
            again += line in seen
            seen.add(line)
        if line_fails(line, n):
            lost += n
        else:
            stay.append(line)
    repeats = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    kept = not failed and (len(words) - lost) * 100 >= KEPT_PERCENT * len(words)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), again, repeats, failed, kept, "\n".join(stay)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge_lines(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with the base counts, base_failed, kept and, if asked for, cleaned_text.

    Null text counts as empty, which has no words and so fails. A line equal to an earlier one
    counts as its repeat; equal documents are judged alike. Input columns with the names of
    the new ones are replaced, all others stay. No rows give no rows.
    """
    new = _parse_datatype_string(COLUMNS + ", cleaned_text string" * with_text)
    rest = docs.drop(*new.names)
    place = rest.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] * with_text
        for batch in batches:
            rows = [judged(t.as_py() or "")[:len(types)] for t in batch.column(place)]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, t) for c, t in zip(columns, types)]], [*batch.schema.names, *new.names]
            )

    return rest.mapInArrow(run, StructType([*rest.schema.fields, *new.fields]))


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with the lines that stay."""
    names = [f.name for f in _parse_datatype_string(COLUMNS).fields]
    kept = judge_lines(docs.drop(*names), text).filter("kept")
    return kept.select(*[F.col("cleaned_text").alias(text) if c == text else F.col(c) for c in docs.columns if c not in names])
