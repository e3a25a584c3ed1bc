"""Document fingerprints of closed syncmers.

Of all substrings of K code points, those are anchors whose least inner substring of S code
points (by hash) is the first or the last. Whether a substring is one depends on nothing
but itself, so equal passages have equal anchors wherever they stand, any shared run of
2 K - S code points has one, and the anchors of a text put together from parts are those of the
parts and of the seams. A fingerprint is the anchors in order with the steps between their places.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of an anchor and of its inner substrings.
K, S = 24, 8
#: Code points whose anchors are worked out at once.
SLICE = 1 << 20
#: Bytes of rows that are given back at once.
BYTES = 8 << 20
#: Rows that a part of the order should have.
PART_ROWS = 2048

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(values: np.ndarray, size: int, joined) -> np.ndarray:
    """``joined`` over every run of ``size`` values, from runs of powers of two."""
    out, reach, run, have = None, 0, values, 1
    while True:
        if size & have:
            if out is None:
                out, reach = run, have
            else:
                n = len(values) - reach - have + 1
                out, reach = joined(out[:n], run[reach:reach + n], have), reach + have
        if reach == size:
            return out
        n = len(run) - have
        run, have = joined(run[:n], run[have:have + n], have), 2 * have


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` code points."""
    power = {}

    def joined(a: np.ndarray, b: np.ndarray, of_b: int) -> np.ndarray:
        factor = power.setdefault(of_b, np.uint64(pow(int(_ODD), of_b, 1 << 64)))
        return a * factor + b

    return _mixed(_runs(_mixed(points.astype("uint64") + np.uint64(1)), size, joined))


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of some code points, in slices."""
    places, hashes = [np.empty(0, "int64")], [np.empty(0, "uint32")]
    for at in range(0, max(len(points) - k + 1, 0), SLICE):
        some = points[at:at + SLICE + k - 1]
        inner = _hashes(some, s)
        width = k - s + 1
        least = _runs(inner, width, lambda a, b, _: np.minimum(a, b))
        here = np.flatnonzero((inner[:len(least)] == least) | (inner[width - 1:] == least))
        places.append(here + at)
        hashes.append((_hashes(some, k)[here] >> np.uint64(32)).astype("uint32"))
    return np.concatenate(places), np.concatenate(hashes)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def spliced(
    head: np.ndarray, of_head: tuple[np.ndarray, np.ndarray], tail: np.ndarray, of_tail: tuple[np.ndarray, np.ndarray], k: int = K, s: int = S
) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of ``head`` followed by ``tail``, from the anchors of texts that begin with them."""
    cut = len(head)
    a = of_head[0] <= cut - k
    b = of_tail[0] <= len(tail) - k
    seam = anchors(np.concatenate([head[max(cut - k + 1, 0):], tail[:k - 1]]), k, s)
    return (
        np.concatenate([of_head[0][a], seam[0] + max(cut - k + 1, 0), of_tail[0][b] + cut]),
        np.concatenate([of_head[1][a], seam[1], of_tail[1][b]]),
    )


def whole_anchor(points: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``found``, or one anchor of the whole text where it has none and is not empty."""
    if len(found[0]) or not len(points):
        return found
    digest = hashlib.blake2b(points.tobytes(), digest_size=4).digest()
    return np.zeros(1, "int64"), np.frombuffer(digest, "<u4")


def spelled(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Ten hexadecimal digits an anchor: the step from the one before (at most 255), then its hash."""
    out = np.empty((len(found[0]), 5), "uint8")
    out[:, 0] = np.minimum(np.diff(found[0], prepend=0), 255)
    out[:, 1:] = found[1].astype(">u4").view("uint8").reshape(-1, 4)
    return out.tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Twice the anchors that match in the same order, divided by all anchors; 1 for two empty texts.

    The i-th anchor of a hash in one text is held against the i-th of it in the other, and
    the longest run of these pairs that rises in both counts.
    """
    n, m = len(a[1]), len(b[1])
    if not n or not m:
        return float(n == m)

    def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order].astype("uint64")
        first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return (sorted_ << np.uint64(32)) | (np.arange(len(order)) - start).astype("uint64"), order

    (x, at_a), (y, at_b) = numbered(a[1]), numbered(b[1])
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    i, j = at_a[i], at_b[j]
    line = j[np.argsort(i)]
    if (line[1:] > line[:-1]).all():
        length = len(line)
    else:
        ends: list[int] = []
        for v in line.tolist():
            at = bisect_left(ends, v)
            ends[at:at + 1] = [v]
        length = len(ends)
    return 2 * length / (n + m)


def _compared(text: str, following: str, k: int, s: int, of_text=None, of_following=None) -> tuple:
    """What is known of a text and the one after it."""
    here, there = code_points(text), code_points(following)
    a, b = of_text or anchors(here, k, s), of_following or anchors(there, k, s)
    taken = len(here) // 2
    head, tail = here[:len(here) - taken], there[:taken]
    edited = np.concatenate([head, tail])
    c = whole_anchor(edited, spliced(head, a, tail, b, k, s))
    a, b = whole_anchor(here, a), whole_anchor(there, b)
    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return len(here), digest, spelled(a), spelled(c), likeness(a, c), likeness(a, b)


_FIELDS = [
    ("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"),
    ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"),
]


def in_order(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """doc_id, text, h (hash of the text), key, and the numbers that part the keys into parts of alike size.

    ``key`` never falls in order of doc_id (null first) and h, so copies of one id can fill
    several parts. Quantiles of it bound the parts, whose number depends on the cluster at most.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    count, low = rows.agg(F.count("*"), F.min(F.col("doc_id").cast("long"))).first()
    low = (low or 0) - 1
    share = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("double"), F.lit(float(low))) + share)
    parts = min(-(-count // PART_ROWS), 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts < 2:
        return rows, np.empty(0)
    found = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return rows, np.array(sorted(set(found)))


def first_of_next(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """The first row of every part, with the part before it (the last part for the very first row) as ``guest_of``."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(bounds, batch.column(0).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns[1:]], ["part", "doc_id", "h"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.select("key", "doc_id", "h").mapInArrow(place, f"part int, doc_id {kind}, h long")
    # One row a part, so at most as many as there are bounds.
    least = sorted(placed.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("x")).collect(), key=lambda r: r.part)
    firsts = [(r.x.doc_id, r.x.h, least[i - 1].part) for i, r in enumerate(least)]
    guests = rows.sparkSession.createDataFrame(firsts, f"g_id {kind}, g_h long, guest_of int")
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h"))
    return rows.join(F.broadcast(guests), same).drop("g_id", "g_h").dropDuplicates(["guest_of"])


def neighbour_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next row's text, in order of doc_id (a whole number; null first, copies of an id by a
    hash of their texts; the first row follows the last). near_edited and near_next are the
    likeness to the edited and to the next text.

    Texts travel once, packed, to the part of the order that they fall into. A part is read in
    order, with one text and the one before it in memory; the first text of the next part is
    its guest. Null text is empty. An empty text has an empty fingerprint; any other
    without anchor (only such of fewer than 2 ``k`` - ``s`` code points) has that of the text as a
    whole. Repeated rows follow one another. Other columns are ignored. No rows give no rows.
    """
    if not 1 <= s < k or k - s > 254:
        raise ValueError("inner substrings must be shorter than anchors, by 254 at most")
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [n for n, _, _ in _FIELDS]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, _, t in _FIELDS)
    rows, bounds = in_order(docs, doc_id, text)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            part = np.searchsorted(bounds, batch.column(0).to_numpy(), "right")
            start, size, made = 0, 0, []
            for i in range(batch.num_rows):
                raw = squeeze.compress((batch.column(4)[i].as_py()).encode("utf-8", "surrogatepass"))
                made.append(raw)
                size += len(raw)
                if size >= BYTES or i == batch.num_rows - 1:
                    some = batch.slice(start, i + 1 - start)
                    to = pc.coalesce(some.column(1), pa.array(part[start:i + 1], pa.int32()))
                    guest = pc.is_valid(some.column(1))
                    yield pa.RecordBatch.from_arrays(
                        [to, guest, some.column(2), some.column(3), pa.array(made, pa.binary())], ["part", "guest", "doc_id", "h", "packed"]
                    )
                    start, size, made = i + 1, 0, []

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        out: list[tuple] = []
        size, before = 0, None

        def told() -> pa.RecordBatch:
            types = [id_type, *[t for _, t, _ in _FIELDS]]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", *names])
            out.clear()
            return batch

        for batch in batches:
            id_type = batch.column(2).type
            for i in range(batch.num_rows):
                part, guest, key, _, packed = (c[i].as_py() for c in batch.columns)
                words = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                found = anchors(code_points(words), k, s)
                # The guest closes its part.
                if before is not None and before[0] == part:
                    row = _compared(before[2], words, k, s, before[3], found)
                    out.append((before[1], *row))
                    size += len(row[2]) + len(row[3])
                before = None if guest else (part, key, words, found)
                if size >= BYTES:
                    yield told()
                    size = 0
        if out:
            yield told()

    columns = ["key", "guest_of", "doc_id", "h", "text"]
    both = rows.withColumn("guest_of", F.lit(None).cast("int")).select(columns).unionByName(first_of_next(rows, bounds).select(columns))
    packed = both.mapInArrow(pack, f"part int, guest boolean, doc_id {kind}, h long, packed binary")
    dealt = packed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "guest", "doc_id", "h")
    return dealt.mapInArrow(walk, schema)
