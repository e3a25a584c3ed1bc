"""Request limiter over a stream; the open window of a caller is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from landledger.operators.limiter import Window
from landledger.session import pickle_by_value, ship

OUTPUT = "caller string, request_id bigint, at_ms bigint, allowed boolean"


class WindowKeeper(StatefulProcessor):
    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start bigint, count bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, count = self.open.get() if self.open.exists() else (None, 0)
        window = Window(self.limit, self.window_ms, start, count)
        arrived = pd.concat(rows).sort_values(["at_ms", "request_id"])
        out = [
            (key[0], int(request_id), int(at), window.allows(int(at)))
            for at, request_id in arrived[["at_ms", "request_id"]].itertuples(index=False)
        ]
        self.open.update((window.start, window.count))
        yield pd.DataFrame(out, columns=["caller", "request_id", "at_ms", "allowed"])

    def close(self) -> None:
        pass


def stream_limiter(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """Verdict on each request of a stream. Needs the RocksDB state store provider."""
    ship(requests.sparkSession)
    pickle_by_value(__name__, Window.__module__)
    timed = requests.select("caller", F.unix_millis("at").alias("at_ms"), "request_id")
    return timed.groupBy("caller").transformWithStateInPandas(
        WindowKeeper(limit, window_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
