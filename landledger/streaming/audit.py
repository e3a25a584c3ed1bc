"""Audit trail over a stream: each document's chain is extended as entries arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from landledger.operators.audit import envelope_head, envelope_tail
from landledger.session import pickle_by_value, ship

OUTPUT = "document_id bigint, entry_id bigint, seq bigint, hash string, prev_hash string"


class ChainKeeper(StatefulProcessor):
    """Keeps the head of each chain and the ids entered, so a replayed entry adds nothing.

    A late entry, with a smaller id or an earlier time than the head's, is appended like any other.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq bigint, hash string")
        self.entered = handle.getMapState("entered", "entry_id bigint", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, head = self.head.get() if self.head.exists() else (-1, None)
        arrived = pd.concat(rows).sort_values(["at_ms", "entry_id"])
        out = []
        for entry_id, content, tail in arrived[["entry_id", "content", "tail"]].itertuples(index=False):
            entry_id = int(entry_id)
            if self.entered.containsKey((entry_id,)):
                continue
            link = "null" if head is None else f'"{head}"'
            previous, seq = head, seq + 1
            head = hashlib.sha256(f"{content}{link}{tail}".encode()).hexdigest()
            self.entered.updateValue((entry_id,), (seq,))
            out.append((key[0], entry_id, seq, head, previous))
        if out:
            self.head.update((seq, head))
        yield pd.DataFrame(out, columns=["document_id", "entry_id", "seq", "hash", "prev_hash"])

    def close(self) -> None:
        pass


def stream_audit(entries: DataFrame) -> DataFrame:
    """document_id, entry_id, seq, hash, prev_hash for a stream of entries.

    An entry is known by its id within the document, which is what makes a replayed file
    harmless; ids need not rise. Entries of one batch are appended by time and then id. Needs
    the RocksDB state store provider.
    """
    ship(entries.sparkSession)
    pickle_by_value(__name__)
    prepared = entries.select(
        "document_id", "entry_id", F.expr(envelope_head()).alias("content"), F.expr(envelope_tail()).alias("tail"),
        F.unix_millis("timestamp").alias("at_ms"),
    )
    return prepared.groupBy("document_id").transformWithStateInPandas(
        ChainKeeper(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
