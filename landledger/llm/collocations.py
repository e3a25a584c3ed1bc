"""Phrase collocations: mergeable Misra-Gries summaries find the frequent phrases, a second pass counts them exactly.

First pass: every task counts the phrases of its texts by hash and deals the counts out to
hash partitions as summaries. A partition merges them under a capacity above its mass
divided by the threshold, so the error of a counter stays below the threshold and every
frequent phrase survives (a clash of hashes only adds to a counter). Second pass: only
phrases whose hash survives are spelled out and counted, and those below the threshold go.
Scores and the choice are joins and aggregates over the frequent phrases alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landledger.llm.shared import join_on_hot, stored

LEAST = 10
TOP = 2000
HELD_PERCENT = 50
UNKNOWN = "und"
#: Words of the longest phrase: three numbers of 21 bits share one key where a task counts.
MOST_WORDS = 3
#: Phrases that a hash partition is made for; it needs a tenth as many counters.
MASS = 1 << 23
#: Bytes of text worked on at once, phrases held before they are counted, distinct ones and words held at most.
BLOCK, HELD, DISTINCT, VOCABULARY = 1 << 20, 2_000_000, 1_500_000, 250_000
#: Bits of the sieve of survivors: at least, and at most (32 MB) whatever the corpus.
SIEVE_BITS = (1 << 20, 1 << 28)

_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAKS + _BLANKS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(_BREAKS) + b" " * len(_BLANKS)
)
_FACTOR, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOW = np.uint64((1 << 40) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def blocks(batch: pa.RecordBatch, longest: int, size: int = BLOCK) -> Iterator[tuple[str, bytes, int]]:
    """(language, plain bytes, words at its start that an earlier block has counted) of the texts of a batch.

    In plain bytes pieces are parted by full stops, words by blanks, and A-Z are lower-cased.
    Texts of a language are put together; a text above ``size`` is cut between words, and the
    next part repeats the words before the cut that later phrases may begin with.
    """
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for i in range(batch.num_rows):
        lang, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        if not text:
            continue
        raw, skip = text.encode("utf-8", "surrogatepass").translate(_PLAIN), 0
        old = 0
        while len(raw) > size:
            # Past what is repeated, so that every part has something new.
            at = max(raw.rfind(b" ", old + 1, size), raw.rfind(b".", old + 1, size))
            if at < 0:
                ends = [k for k in (raw.find(b" ", max(size, old + 1)), raw.find(b".", max(size, old + 1))) if k > 0]
                if not ends:
                    break
                at = min(ends)
            yield lang, raw[:at], skip
            tail = raw[:at].rsplit(b".", 1)[-1].split()[1 - longest:] if longest > 1 else []
            # A full stop at the cut parts the pieces, so nothing goes on over it.
            tail = [] if raw[at:at + 1] == b"." else tail
            raw, skip, old = b" ".join([*tail, raw[at + 1:]]), len(tail), sum(len(w) + 1 for w in tail)
        if skip or len(raw) > size:
            yield lang, raw, skip
            continue
        held.setdefault(lang, []).append(raw)
        sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
        if sizes[lang] > size:
            yield lang, b".".join(held.pop(lang)), 0
            sizes[lang] = 0
    for lang, parts in held.items():
        yield lang, b".".join(parts), 0


class Phrases:
    """The words of a block and the hashes of its phrases, as arrays."""

    def __init__(self, raw: bytes, skip: int, powers: list[np.ndarray]):
        a = np.frombuffer(raw, "uint8")
        stop = a == 46
        word = np.concatenate([[False], ~(stop | (a == 32)), [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        #: Piece of every word.
        self.piece = np.cumsum(stop, dtype="int64")[self.starts] if len(self.starts) else np.empty(0, "int64")
        self.skip, self.raw = skip, raw
        if len(powers[0]) < len(a):
            for i, factor in enumerate((_FACTOR, _INVERSE)):
                p = np.full(max(len(a), BLOCK + BLOCK // 4), factor, "uint64")
                p[0] = 1
                powers[i] = np.cumprod(p)
        sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum((a.astype("uint64") + np.uint64(1)) * powers[0][:len(a)])])
        self.hashes = _mixed((sums[self.ends] - sums[self.starts]) * powers[1][self.starts])

    def begins(self, size: int) -> np.ndarray:
        """The first words of the phrases of ``size`` words that this block counts."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.empty(0, "int64")
        at = np.flatnonzero(self.piece[:n] == self.piece[size - 1:]) if size > 1 else np.arange(n)
        return at[at + size > self.skip]

    def keys(self, at: np.ndarray, size: int, lang: int) -> np.ndarray:
        out = np.full(len(at), lang + size, "uint64")
        for k in range(size):
            out = _mixed(out * np.uint64(_FACTOR) + self.hashes[at + k])
        return out


def _language_number(lang: str) -> int:
    return int.from_bytes(lang.encode("utf-8", "surrogatepass")[:4], "little") << 8


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes; those that are mostly zero take next to nothing."""
    return values.astype("<u8").view("uint8").reshape(-1, 8).T.tobytes()


class Summary:
    """Misra-Gries counters of one hash partition.

    ``error`` is what a count may be short by. Merging adds counters up and then takes
    the largest count that has to go from all of them, so error stays at most mass / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.empty(0, "uint64"), np.empty(0, "int64")
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys, counts = zip((self.keys, self.counts), *self.waiting)
        self.keys, self.counts = _counted(np.concatenate(keys), np.concatenate(counts))
        self.waiting, self.n_waiting = [], 0
        over = len(self.keys) - self.capacity
        if over > 0:
            less = np.partition(self.counts, over - 1)[over - 1]
            left = self.counts > less
            self.keys, self.counts, self.error = self.keys[left], self.counts[left] - less, self.error + int(less)

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may have been counted ``least`` times."""
        self.merge()
        return self.keys[self.counts + self.error >= least]

    def dump(self) -> bytes:
        steps = np.diff(self.keys, prepend=np.uint64(0))
        return zstandard.ZstdCompressor(level=1).compress(_planes(steps) + _planes(self.counts))

    @staticmethod
    def load(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "uint8").reshape(2, 8, -1)
        steps, counts = (np.ascontiguousarray(p.T).view("<u8").reshape(-1) for p in planes)
        return np.cumsum(steps.astype("uint64")), counts.astype("int64")


def summaries(texts: DataFrame, longest: int, parts: int) -> DataFrame:
    """part, mass, summary: what the tasks have counted, for every hash partition.

    A row without summary has the mass and comes first in order, so that a partition knows its
    capacity before it merges.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [np.empty(0, "uint64")] * 2
        held: list[np.ndarray] = []
        n_held = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            part = ((keys >> np.uint64(40)) % np.uint64(parts)).astype("int64")
            order = np.argsort(part, kind="stable")
            keys, counts, part = keys[order] & _LOW, counts[order].astype("int64"), part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            masses = np.add.reduceat(counts, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[first], pa.int32()), pa.array(masses, pa.int64()), pa.nulls(len(first), pa.binary())], ["part", "mass", "summary"]
            )
            for k, (a, b) in enumerate(zip(first, [*first[1:], len(keys)])):
                own = Summary(b - a)
                own.add(keys[a:b], counts[a:b])
                own.merge()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[a]], pa.int32()), pa.array([masses[k]], pa.int64()), pa.array([own.dump()], pa.binary())], ["part", "mass", "summary"]
                )

        for batch in batches:
            for lang, raw, skip in blocks(batch, longest):
                found = Phrases(raw, skip, powers)
                for size in range(1, longest + 1):
                    keys = found.keys(found.begins(size), size, _language_number(lang))
                    held.append(keys)
                    n_held += len(keys)
                if n_held >= HELD:
                    yield from dealt()
                    held, n_held = [], 0
        if n_held:
            yield from dealt()

    return texts.mapInArrow(run, "part int, mass long, summary binary")


def frequent_sieve(texts: DataFrame, mass: int, longest: int, least: int) -> tuple[np.ndarray, int]:
    """Bits that are set for every phrase found ``least`` times or more, and the number of partitions they are dealt to.

    A part of the sieve comes from every partition; all of them together have at most
    ``SIEVE_BITS``. Beyond a hundred million frequent phrases it lets more of the others
    through, which costs time and not truth.
    """
    spark = texts.sparkSession
    parts = max(-(-mass // MASS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = 1 << (2 * mass // least).bit_length()
    width = -(-min(max(wanted, SIEVE_BITS[0]), SIEVE_BITS[1]) // (8 * parts))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass_, own = None, 0, None

        def ended() -> pa.RecordBatch:
            bits = np.zeros(8 * width, "uint8")
            bits[own.survivors(least) % np.uint64(8 * width)] = 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for i in range(batch.num_rows):
                at, more, raw = (c[i].as_py() for c in batch.columns)
                if at != part:
                    if own is not None:
                        yield ended()
                    part, mass_, own = at, 0, None
                if raw is None:
                    mass_ += more
                    continue
                own = own or Summary(mass_ // least + 1)
                own.add(*Summary.load(raw))
        if own is not None:
            yield ended()

    dealt = summaries(texts, longest, parts).repartitionById(parts, "part")
    made = dealt.sortWithinPartitions("part", F.col("summary").isNotNull()).mapInArrow(merge, "part int, bits binary")
    bits = np.zeros((parts, width), "uint8")
    for r in made.toLocalIterator():
        bits[r.part] = np.frombuffer(r.bits, "uint8")
    return bits.reshape(-1), parts


class Numbers(dict):
    """Words and the numbers they get as they come, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


class Tally:
    """Exact counts of phrases of one language in one task."""

    def __init__(self) -> None:
        self.numbers = Numbers()
        self.keys, self.counts = np.empty(0, "uint64"), np.empty(0, "int64")
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def words(self, found: Phrases) -> np.ndarray:
        """The number of every word of the block."""
        if not len(found.starts):
            return np.empty(0, "uint64")
        # A blank at either end would give an empty word.
        plain = found.raw.replace(b".", b" ").strip(b" ")
        ends = np.array([0, len(plain)], "int64")
        whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(ends), pa.py_buffer(plain)])
        coded = pc.ascii_split_whitespace(whole).values.dictionary_encode()
        own = np.fromiter(map(self.numbers.__getitem__, coded.dictionary.cast(pa.large_binary()).to_pylist()), "uint64", len(coded.dictionary))
        return own[coded.indices.to_numpy()]

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.n_held += len(keys)
        if self.n_held >= HELD:
            self.merge()

    def merge(self) -> None:
        keys, counts = np.unique(np.concatenate(self.held or [np.empty(0, "uint64")]), return_counts=True)
        self.keys, self.counts = _counted(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts.astype("int64")]))
        self.held, self.n_held = [], 0

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """lang, phrase, size, n of all that was counted."""
        self.merge()
        spelled = pa.array([b"", *self.numbers], pa.binary())
        for at in range(0, len(self.keys), 100_000):
            keys, counts = self.keys[at:at + 100_000], self.counts[at:at + 100_000]
            columns = [(keys >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1) for k in reversed(range(MOST_WORDS))]
            sizes = sum((c > 0).astype("int32") for c in columns)
            for size in range(1, MOST_WORDS + 1):
                own = sizes == size
                words = [spelled.take(pa.array(c[own].astype("int64"))) for c in columns[MOST_WORDS - size:]]
                phrase = words[0] if size == 1 else pc.binary_join_element_wise(*words, b" ")
                n = int(own.sum())
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n, pa.string()), phrase.cast(pa.string()), pa.array(np.full(n, size), pa.int32()), pa.array(counts[own], pa.int64())],
                        ["lang", "phrase", "size", "n"],
                    )


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = MOST_WORDS, least: int = LEAST) -> DataFrame:
    """lang, phrase, size, n: every phrase of up to ``longest`` words found ``least`` times or more in its language, stored.

    Words are runs without blanks (space, tab), A-Z lower-cased; phrases do not reach over
    one of ``.,;:!?`` or a line break. Null and empty texts have none; null language is und.
    Repeated rows count each; other columns are ignored. No rows give no rows.
    """
    if not 1 <= longest <= MOST_WORDS or least < 1:
        raise ValueError(f"phrases of 1 to {MOST_WORDS} words and a threshold from 1 on")
    texts = docs.select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).filter("text is not null")
    spark = docs.sparkSession
    mass = longest * (texts.agg(F.sum(word_count(F.col("text")))).first()[0] or 0)
    sieve, parts = frequent_sieve(texts, mass, longest, least)
    shared = spark.sparkContext.broadcast(sieve)
    width = np.uint64(8 * (len(sieve) // parts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, tallies = [np.empty(0, "uint64")] * 2, {}
        bits = shared.value
        for batch in batches:
            for of, raw, skip in blocks(batch, longest):
                found = Phrases(raw, skip, powers)
                tally = tallies.setdefault(of, Tally())
                words = tally.words(found)
                for size in range(1, longest + 1):
                    at = found.begins(size)
                    keys = found.keys(at, size, _language_number(of))
                    place = ((keys >> np.uint64(40)) % np.uint64(parts)) * width + (keys & _LOW) % width
                    at = at[(bits[(place >> np.uint64(3)).astype("int64")] >> (np.uint64(7) - (place & np.uint64(7))).astype("uint8")) & 1 > 0]
                    packed = np.zeros(len(at), "uint64")
                    for k in range(size):
                        packed = (packed << np.uint64(21)) | words[at + k]
                    tally.add(packed)
                if sum(len(t.keys) for t in tallies.values()) > DISTINCT or sum(len(t.numbers) for t in tallies.values()) > VOCABULARY:
                    for name, t in tallies.items():
                        yield from t.rows(name)
                    tallies = {}
        for name, t in tallies.items():
            yield from t.rows(name)

    counted = texts.mapInArrow(run, "lang string, phrase string, size int, n long")
    return stored(counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def word_count(text: Column) -> Column:
    """Words of a text, as many as the phrases of one word."""
    return F.regexp_count(text, F.lit("[^ \t\n\x0b\x0c\r.,;:!?]+")).cast("long")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", shortest: int = 2, longest: int = MOST_WORDS,
    least: int = LEAST, held_percent: int = HELD_PERCENT, top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language.

    A phrase of ``shortest`` to ``longest`` words found a >= ``least`` times is cut where
    floor(10^6 * a * a / (l * r)) is least, at the first such place; l and r are how often its parts are
    found, n the words of the language. Phrases within a longer one that is found in
    ``held_percent`` of their places or more are left out. Order: score, a, then the bytes of the
    phrase. Texts, nulls and repeated rows are taken as by ``frequent_phrases``. Counts are exact up to 10^16.
    """
    frequent = frequent_phrases(docs, text, lang, longest, least)
    wanted = frequent.filter(F.col("size") >= shortest)
    words = F.split("phrase", " ")

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, start, length), " ")

    # What every phrase asks for: how often the parts of each of its cuts are found.
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    asked = stored(
        wanted.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), cut.alias("cut"))
        .select("lang", F.col("phrase").alias("whole"), "a", "cut", F.explode(F.array(
            F.struct(F.lit("l").alias("side"), joined(F.lit(1), F.col("cut")).alias("phrase")),
            F.struct(F.lit("r").alias("side"), joined(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("phrase")),
        )).alias("part"))
        .select("lang", "whole", "a", "cut", "part.side", "part.phrase")
    )
    known = stored(frequent.select("lang", "phrase", "n").join(asked.groupBy("lang", "phrase").agg(F.count("*").alias("n_asked")), ["lang", "phrase"]))
    found = join_on_hot(asked, known, ["lang", "phrase"], "n_asked")
    # Every cut has one left and one right part; whole numbers of up to 38 digits keep products exact.
    cuts = found.groupBy("lang", "whole", "a", "cut").agg(F.max(F.expr("if(side = 'l', n, null)")).alias("l"), F.max(F.expr("if(side = 'r', n, null)")).alias("r"))
    score = F.expr("(1000000 * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", F.col("whole").alias("phrase"), "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    scored = scored.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # The longer phrase that is found most often, for every phrase within one.
    length = F.explode(F.sequence(F.lit(shortest), F.col("size") - 1))
    inside = (
        wanted.filter(F.col("size") > shortest).select("phrase", "lang", "size", "n", length.alias("length"))
        .select("lang", "n", "length", "phrase", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("start"))
        .select("lang", "n", joined(F.col("start"), F.col("length")).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    )
    left = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * held_percent))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = left.withColumn("rank", rank).filter(F.col("rank") <= top)
    totals = docs.select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), word_count(F.col(text)).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
