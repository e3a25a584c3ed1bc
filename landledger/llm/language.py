"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are learned with follow-the-regularised-leader under elastic-net penalties, and the
scores are calibrated with one temperature. Document frequencies come from every learning row;
the weights from a sample whose size is bounded per language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Buckets of n-grams; lengths of n-grams, in letters and the gaps between words.
BUCKETS = 2**15
LENGTHS = (2, 3)
#: Expected rows of a language in the learning sample; every fifth of them calibrates.
PER_LANGUAGE = 500
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
UNKNOWN = "und"

_FACTORS = [np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263)]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


class Features:
    """Sparse counts of a text's character n-grams."""

    def __init__(self, buckets: int = BUCKETS, lengths: tuple[int, ...] = LENGTHS):
        self.shift, self.buckets, self.lengths = np.uint32(32 - (buckets.bit_length() - 1)), buckets, lengths
        self.letter = np.array([chr(c).isalpha() for c in range(2**16)])

    def codes(self, text: str) -> np.ndarray:
        """Lower-case letters with one space for whatever is between them; empty without letters."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        letter = self.letter[np.minimum(c, 2**16 - 1)]
        for x in np.unique(c[c >= 2**16]):
            letter = letter | ((c == x) & chr(x).isalpha())
        if not letter.any():
            return c[:0]
        c = np.concatenate(([32], np.where(letter, c, 32), [32])).astype("uint32")
        return c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Buckets and 1 + log of their counts; None without letters."""
        c = self.codes(text)
        if not len(c):
            return None
        found = []
        for n in self.lengths:
            h = np.full(max(len(c) - n + 1, 0), n, "uint32")
            for i in range(n):
                h = (h ^ c[i:i + len(h)]) * _FACTORS[i % 4]
                h ^= h >> np.uint32(15)
            found.append((h * _FACTORS[3]) >> self.shift)
        counts = np.bincount(np.concatenate(found), minlength=self.buckets)
        some = np.flatnonzero(counts)
        return some, (1 + np.log(counts[some])).astype("float32")


def _scaled(idf: np.ndarray, some: np.ndarray, tf: np.ndarray) -> np.ndarray:
    x = tf * idf[some]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def follow_the_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, buckets: int, seed: int = 7) -> np.ndarray:
    """Weights by class and bucket from (class, buckets, values) rows, FTRL-proximal with both penalties."""
    z, n = np.zeros((classes, buckets)), np.zeros((classes, buckets))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            y, some, x = rows[i]
            zs, ns = z[:, some], n[:, some]
            w = weights(zs, ns)
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            z[:, some] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[:, some] = ns + g * g
    return weights(z, n)


def fitted_temperature(logits: list[np.ndarray], truth: list[int]) -> float:
    """The divisor of logits under which the truth is likeliest, between 1/100 and 100.

    As in Platt's scaling one row more than there are counts as told wrong, spread over the
    rows, so that a small sample without errors does not make every score 1.
    """
    if not logits:
        return 1.0
    wrong = 1 / (len(logits) + 2)

    def loss(t: float) -> float:
        total = 0.0
        for x, y in zip(logits, truth):
            log = np.log(softmax(x / t) + 1e-12)
            others = (log.sum() - log[y]) / max(len(log) - 1, 1)
            total -= (1 - wrong) * log[y] + wrong * others
        return float(total)

    grid = np.exp(np.linspace(np.log(0.01), np.log(100), 41))
    best = float(min(grid, key=loss))
    return float(min(best * np.exp(np.linspace(-0.25, 0.25, 21)), key=loss))


def _document_counts(texts: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts have letters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets + 1, "int64")
        for batch in batches:
            for t in batch.column(0):
                if (got := features(t.as_py() or "")) is not None:
                    total[got[0]] += 1
                    total[buckets] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    counts = np.zeros(buckets + 1, "int64")
    for bucket, n in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        counts[bucket] = n
    return counts[:buckets], int(counts[buckets])


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS) -> Model | None:
    """Learn from doc_id, text and lang; rows with a null in any are left out. None without rows.

    Document frequencies are counted over all rows. Weights are learned from the rows whose
    hash of doc_id is below a bound, set so that about ``per_language`` rows of each language
    are expected (all of a rarer one); their sparse features come to the driver.
    """
    rows = rows.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null")
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    counts, n = _document_counts(rows.select("text"), buckets)
    idf = (np.log((1 + n) / (1 + counts)) + 1).astype("float32")
    bound = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(10**9)) / F.lit(10**9)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            got = [(k, y, features(t)) for k, y, t in zip(*(c.to_pylist() for c in batch.columns))]
            got = [(k, y, f[0].astype("<u4").tobytes(), f[1].tobytes()) for k, y, f in got if f is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got)], ["draw", "lang", "some", "tf"])

    sample = rows.filter(draw < F.element_at(bound, F.col("lang"))).select(F.xxhash64("doc_id").alias("draw"), "lang", "text")
    drawn = sorted(sample.mapInArrow(run, "draw long, lang string, some binary, tf binary").collect(), key=lambda r: (r.draw, r.lang, r.some))
    ready = []
    for r in drawn:
        some = np.frombuffer(r.some, "<u4")
        ready.append((languages.index(r.lang), some, _scaled(idf, some, np.frombuffer(r.tf, "float32"))))
    weights = follow_the_leader([x for i, x in enumerate(ready) if i % 5], len(languages), buckets)
    tried = [x for i, x in enumerate(ready) if i % 5 == 0]
    temperature = fitted_temperature([weights[:, some] @ x for _, some, x in tried], [y for y, _, _ in tried])
    return Model(languages, idf, weights.astype("float32"), temperature)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), read off the whole text.

    Null texts and texts without a letter, and all texts without a model, get "und" and 0.
    Equal scores go to the first language by name. Input columns of these names are replaced;
    all other columns stay. No rows give no rows.
    """
    rest = docs.drop("lang_pred", "score")
    place = rest.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*rest.schema.fields, *_parse_datatype_string("lang_pred string, score double").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(len(model.idf)) if model else None
        for batch in batches:
            names, scores = [], []
            for t in batch.column(place):
                got = features(t.as_py() or "") if model else None
                if got is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                some, tf = got
                p = softmax(model.weights[:, some] @ _scaled(model.idf, some, tf) / model.temperature)
                names.append(model.languages[int(p.argmax())])
                scores.append(min(1.0, float(p.max())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
            )

    return rest.mapInArrow(run, schema)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Every fifth document by a checksum of its id; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
