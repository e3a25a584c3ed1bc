"""Training-order materialisation: a keyed permutation gives every sequence its slot; shards have a fixed stride."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.llm.packing import END_ID, TOKENIZER, worker_encoder
from landledger.llm.shared import stored

TOKENS = 512
#: Sequences of a shard and of one row of it; a row is what a reader takes at once.
SHARD, ROW = 16384, 512
ROUNDS = 6
KEY = 20240229


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(index: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """Where 0 to count - 1 go under the keyed permutation of these numbers.

    A Feistel network permutes the numbers of twice as many bits as half of ``count`` takes;
    what it sends to ``count`` or beyond is sent on until it is below.
    """
    half = np.uint64(max(1, -(-max(count - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    out, walking = index.astype("uint64"), np.arange(len(index))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ (_mixed(right + _mixed(np.array([key * ROUNDS + turn], "uint64"))) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= count]
    return out.astype("int64")


def token_sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, tokens: int = TOKENS) -> DataFrame:
    """doc_id, piece, length, ids (little-endian unsigned 16-bit) of the pieces of every document with its end id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = worker_encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for some in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = []
                for key, t in zip(some.column(0).to_pylist(), some.column(1)):
                    ids = np.frombuffer(encode(t.as_py() or "") + end, "<u4")
                    if ids.max() >= 2**16:
                        raise ValueError("ids of 16 bits do not hold this vocabulary")
                    raw = ids.astype("<u2").tobytes()
                    rows += [(key, i, len(p) // 2, p) for i, p in enumerate(raw[k:k + 2 * tokens] for k in range(0, len(raw), 2 * tokens))]
                columns = list(zip(*rows)) or [()] * 4
                types = [some.column(0).type, pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "length", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, length int, ids binary")


def write_shards(docs: DataFrame, key: int = KEY, tokens: int = TOKENS, shard: int = SHARD, row: int = ROW, **options) -> DataFrame:
    """The shards, as written: shard, first_slot, doc_ids, pieces, lengths, payload in rows of up to ``row`` sequences.

    Slot s is in shard s // ``shard`` at byte s % ``row`` * 2 * ``tokens`` of the payload of the
    row that begins at s - s % ``row``; shorter sequences are filled with zeros. So any slot is
    found without reading what comes before it.

    The order is settled by ``key`` and by how the stored pieces lie in files, so the same input, read in the
    same splits, gives the same order. ``ids`` above 65,535 raise ValueError.

    Null and empty texts are the end id alone. Repeated rows get slots of their own. No rows
    give no shards. Other columns are ignored.
    """
    pieces = stored(token_sequences(docs, tokens=tokens, **options), compression="zstd")
    # A sequence's number is its place in the stored files, in order of their names: counts per file
    # (a row each) are enough, and the sequences themselves travel once, to their shard.
    placed_in = pieces.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = placed_in.groupBy("file").agg(F.count("*").alias("held"))
    bases, count = [], 0
    for r in sorted(files.collect(), key=lambda r: r.file):
        bases.append((r.file, count))
        count += r.held
    based = docs.sparkSession.createDataFrame(bases, "file string, base long")
    numbered = placed_in.join(F.broadcast(based), "file").withColumn("place", F.col("base") + F.col("at"))

    @F.pandas_udf("long")
    def slot_of(place: pd.Series) -> pd.Series:
        return pd.Series(slots(place.to_numpy(), count, key))

    # Only the numbers go through Python here, the sequences stay where they are.
    slot, kind = F.col("slot"), pieces.schema["doc_id"].dataType.simpleString()
    placed = numbered.withColumn("slot", slot_of("place")).select(
        "doc_id", "piece", "length", "ids", "slot", F.expr(f"slot div {shard}").alias("shard"), (slot - slot % row).alias("first_slot")
    )

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def written() -> pa.RecordBatch:
            docs_, pieces_, lengths, ids, _, shards, firsts = zip(*held)
            payload = b"".join(x.ljust(2 * tokens, b"\0") for x in ids)
            columns = [[shards[0]], [firsts[0]], [docs_], [pieces_], [lengths], [payload]]
            types = [pa.int64(), pa.int64(), pa.list_(own), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "first_slot", "doc_ids", "pieces", "lengths", "payload"])

        for batch in batches:
            own = batch.column(0).type
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][6] != x[6]:
                    yield written()
                held.append(x)
        if held:
            yield written()

    parts = max(1, -(-count // shard))
    ordered = placed.repartitionById(parts, F.col("shard").cast("int")).sortWithinPartitions("slot")
    return stored(ordered.mapInArrow(fill, f"shard long, first_slot long, doc_ids array<{kind}>, pieces array<int>, lengths array<int>, payload binary"), compression="zstd")


def slots_of(shards: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """doc_id, piece, slot, shard, length, ids_crc32 (over 16-bit ids) of every sequence, read off the shards."""
    each = F.arrays_zip("doc_ids", "pieces", "lengths")
    return shards.select("shard", "first_slot", "payload", F.posexplode(each).alias("at", "x")).select(
        F.col("x.doc_ids").alias("doc_id"), F.col("x.pieces").alias("piece"), (F.col("first_slot") + F.col("at")).alias("slot"), "shard",
        F.col("x.lengths").alias("length"),
        F.crc32(F.substr("payload", F.col("at") * 2 * tokens + 1, F.col("x.lengths") * 2)).alias("ids_crc32"),
    )


def read_from(shards: DataFrame, slot: int, tokens: int = TOKENS) -> DataFrame:
    """slot, ids from ``slot`` on, in order: where a reader resumes. Rows before it are skipped by their statistics.

    How many sequences a row holds is read off the shards; no shards give no rows.
    """
    row = shards.agg(F.max(F.size("lengths"))).first()[0] or 1
    rows = shards.filter(F.col("first_slot") > slot - row)
    ids = F.substr("payload", F.col("at") * 2 * tokens + 1, F.element_at("lengths", F.col("at") + 1) * 2)
    return rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("lengths") - 1))).select(
        (F.col("first_slot") + F.col("at")).alias("slot"), ids.alias("ids")
    ).filter(F.col("slot") >= slot).orderBy("slot")
