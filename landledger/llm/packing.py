"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

The plan is made over the number of pieces of each length, at most as many numbers as a
sequence has tokens, whatever the corpus; every piece then looks up its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.functions.ordered import with_position
from landledger.session import settle

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct short words whose ids a worker keeps, besides as many that it has met before these.
KEPT_WORDS = 150_000


def byte_letters() -> dict[int, int]:
    """The character that stands for a byte in the vocabulary: itself if it is printed, or else the next from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: 256 + i for i, b in enumerate(hidden)}


LETTERS = byte_letters()


class Encoder(dict):
    """Ids of texts by a tokenizer that lower-cases and whose words never span a space or line feed.

    Texts are cut there, and before a full stop or comma at the end of a word; the parts met so
    far are the keys of this dictionary, with their ids as little-endian unsigned 32-bit numbers.
    """

    END = re.compile(rb"[.,](?<=[a-z][.,])(?=[ \n])")
    #: ASCII but A-Z and the letters of Latin-1: normalising only lower-cases these, so a part is cut here by the tokenizer's rules.
    KNOWN = re.compile("[\x00-@\\[-\x7fß-öø-ÿ]+").fullmatch
    WORDS = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^\\x20\\x09-\\x0Da-z0-9ß-öø-ÿ]+").findall

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, part: bytes) -> bytes:
        raw = self.old.pop(part, None) or self.encoded(part)
        if len(part) <= 64:
            # Words that are met again and again move on to the new table, the others go with the old one.
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[part] = raw
        return raw

    def encoded(self, part: bytes) -> bytes:
        if part.isalpha() and part.islower():
            ids = [t.id for t in self.model.tokenize(part.decode())]
        elif b"<|" not in part and self.KNOWN(word := part.decode().lower()):
            words = self.WORDS(word)
            if words != [part.decode()]:
                return b"".join([self[w.encode()] for w in words])
            ids = [t.id for t in self.model.tokenize(part.decode("latin-1").translate(LETTERS))]
        else:
            ids = self.tokenizer.encode(part.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        # Names of special tokens are told apart by case, so such texts stay as they are.
        raw = raw if b"<|" in raw else raw.lower()
        parts = self.END.sub(rb" \g<0>", raw).replace(b"\n", b" ").split(b" ")
        return b"".join(map(self.__getitem__, parts))


def worker_encoder(tokenizer: str) -> Encoder:
    """The encoder of this Python worker, which serves one task after another."""
    kept = sys.modules.setdefault("_landledger_worker", types.ModuleType("_landledger_worker")).__dict__
    if tokenizer not in kept:
        kept[tokenizer] = Encoder(public_tokenizers.path(tokenizer))
    return kept[tokenizer]


def token_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most ``capacity`` tokens; ids if asked for.

    A document is the ids of its text and then ``end_id``; null text is empty. Only longer
    documents are cut, into full pieces and a rest.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = worker_encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    row = (key, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, "<u4").astype("int32"),) if with_ids else row)
            types = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*rows)) or [()] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names[:len(columns)])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, pieces of it in each bin)]) such that every piece has a place.

    A bin starts with the longest piece left and is filled with the longest that fit. If a
    gap is left, its smallest piece gives way to the two unpacked pieces that together fill
    the gap and its place best, when these fill more. Bins that come out alike are made at once.
    """
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    plan = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity

        def spare(n: int) -> int:
            return left[n] - used.get(n, 0)

        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            if take := min(spare(n), gap // n):
                used[n] = used.get(n, 0) + take
                gap -= take * n
            at = min(at - 1, bisect_right(lengths, gap) - 1)
        if gap and sum(used.values()) > 1:
            small = min(used)
            best, pair, room = small, None, gap + small
            for at in range(bisect_right(lengths, room - 1) - 1, -1, -1):
                a = lengths[at]
                if 2 * a <= best or best == room:
                    break
                if not spare(a):
                    continue
                lower = min(at, bisect_right(lengths, room - a) - 1)
                while lower >= 0 and (spare(lengths[lower]) < 1 + (lower == at)) and a + lengths[lower] > best:
                    lower -= 1
                if lower >= 0 and a + lengths[lower] > best:
                    best, pair = a + lengths[lower], (a, lengths[lower])
            if pair:
                used[small] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
                used = {n: k for n, k in used.items() if k}
        bins = min(left[n] // k for n, k in used.items())
        plan.append((bins, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= bins * k
        lengths = [n for n in lengths if left[n]]
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with sequence_id and offset.

    Lengths must be 1 to ``capacity``. ``pieces`` is read twice, so it should be stored.
    Equal rows get places of their own. No rows give no rows.
    """
    counts = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity``
    plan = best_two_fit(counts, capacity)
    #: By length: the ranks at which a new kind of bin begins, and for each its first bin, pieces a bin and first offset.
    turns: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    ranks, first = dict.fromkeys(counts, 0), 0
    for bins, used in plan:
        offset = 0
        for n, k in used:
            turns[n].append((ranks[n], first, k, offset))
            ranks[n] += bins * k
            offset += n * k
        first += bins
    places = {n: np.array(t, "int64") for n, t in turns.items()}

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rank = df.pop("rank").to_numpy() - 1
            length = df["length"].to_numpy()
            sequence, offset = np.empty(len(df), "int64"), np.empty(len(df), "int64")
            order = np.argsort(length, kind="stable")
            ends = np.flatnonzero(np.diff(length[order])) + 1
            for some in np.split(order, ends) if len(order) else []:
                table, r = places[int(length[some[0]])], rank[some]
                start, bin_, k, base = table[np.searchsorted(table[:, 0], r, "right") - 1].T
                sequence[some] = bin_ + (r - start) // k
                offset[some] = base + (r - start) % k * length[some]
            df["sequence_id"], df["offset"] = sequence, offset
            yield df

    blocks = max(1, min(2**16, sum(counts.values()) // 2000))
    ranked = with_position(pieces, ["length"], ["doc_id", "piece"], f"pmod(xxhash64(doc_id, piece), {blocks})", "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, "rank").mapInPandas(place, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    Null and empty texts are one piece of the end id. Repeated rows are packed each; other
    columns are ignored. No rows give no rows.
    """
    return pack(settle(token_pieces(docs, doc_id, text, **options)), options.get("capacity", CAPACITY))


def sequences(docs: DataFrame, packed: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """sequence_id and ids of every sequence, from the documents and where their pieces went."""
    pieces = token_pieces(docs, doc_id, text, with_ids=True, **options).select("doc_id", "piece", "ids_crc32", "ids")
    # Repeated rows have the same ids, so any of them fills a place.
    once = pieces.dropDuplicates(["doc_id", "piece", "ids_crc32"]).withColumnsRenamed({"doc_id": "d", "piece": "p", "ids_crc32": "c"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("piece") == F.col("p")) & (F.col("ids_crc32") == F.col("c"))
    return packed.join(once, same).groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
