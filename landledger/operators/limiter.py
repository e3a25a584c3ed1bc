"""Request limiter: so many requests per caller in a window anchored at the first one."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.functions.ordered import scan_sorted
from landledger.session import settle

#: Rows of a block of a hot caller. Callers with fewer rows are streamed whole.
BLOCK = 100_000
#: A hot caller has more than one in so many of all rows, so there are fewer of them than that.
SHARE = 1000


class Window:
    """Open window of one caller. A refused request neither counts nor extends it."""

    def __init__(self, limit: int, window_ms: int, start: int | None = None, count: int = 0):
        self.limit, self.window_ms, self.start, self.count = limit, window_ms, start, count

    def allows(self, at: int) -> bool:
        if self.start is None or at - self.start >= self.window_ms:
            self.start, self.count = at, 1
            return True
        if self.count >= self.limit:
            return False
        self.count += 1
        return True

    def feed(self, row: tuple):
        caller, at, request_id = row
        yield (caller, request_id, at, self.allows(at))

    def finish(self):
        return ()


class Transitions:
    """What a block does to any window that is open where it begins, from its times, latest first.

    A window that ends at or before ``upto`` (and after the ``upto`` before) is followed by windows
    of the block; the last of them ends at ``ends`` and has ``count`` requests up to the end of the
    block. Earlier starts never lead to later ends, so equal ends are neighbours and are told once.
    The row without ``upto`` counts the requests of the block, for windows that outlast it. Kept are
    the times of one window after the present one.
    """

    def __init__(self, key: tuple, window_ms: int):
        self.key, self.window_ms = key, window_ms
        self.later: deque[tuple[int, int, int]] = deque()
        self.at, self.seen, self.told = None, 0, None

    def closed(self):
        """The present time has all its requests: it may begin a window."""
        if self.at is None:
            return
        later, end = self.later, self.at + self.window_ms
        while len(later) > 1 and later[1][0] >= end:
            later.popleft()
        ends, count = later[0][1:] if later and later[0][0] >= end else (end, self.seen)
        later.append((self.at, ends, count))
        if ends != self.told:
            self.told = ends
            yield (*self.key, self.at, ends, count)

    def feed(self, row: tuple):
        at = row[-1]
        if at != self.at:
            yield from self.closed()
            self.at = at
        self.seen += 1

    def finish(self):
        yield from self.closed()
        yield (*self.key, None, None, self.seen)


class Entries:
    """The window that is open where each block of a caller begins, from the transitions in order."""

    def __init__(self, caller: str):
        self.caller, self.ends, self.count, self.block, self.through = caller, None, 0, 0, True

    def feed(self, row: tuple):
        _, block, upto, ends, count = row
        if upto is None:
            if not self.through:
                self.count += self.block
            self.block, self.through = count, False
            yield (self.caller, block, self.ends, self.count)
        elif not self.through and (self.ends is None or self.ends <= upto):
            self.ends, self.count, self.through = ends, count, True

    def finish(self):
        return ()


class Resumed:
    """The requests of a block, from the window on that is open where it begins."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms, self.window = limit, window_ms, None

    def feed(self, row: tuple):
        caller, _, at, request_id, ends, count = row
        if self.window is None:
            start = None if ends is None else ends - self.window_ms
            self.window = Window(self.limit, self.window_ms, start, min(count, self.limit))
        yield (caller, request_id, at, self.window.allows(at))

    def finish(self):
        return ()


def _in_blocks(timed: DataFrame, blocks: int, limit: int, window_ms: int) -> DataFrame:
    """The answers to callers whose rows are many: blocks side by side, with what each does to an open window."""
    cut = settle(
        timed.repartitionByRange(blocks, "caller", "at_ms", "request_id").withColumn("block", F.spark_partition_id())
    )
    keys = ["caller", "block"]
    done = scan_sorted(
        cut.select(*keys, "at_ms"), keys, [F.desc("at_ms")], lambda key: Transitions(key, window_ms),
        "caller string, block int, upto bigint, ends bigint, count bigint",
    )
    entered = scan_sorted(
        done, ["caller"], ["block", F.asc_nulls_first("upto")], lambda key: Entries(*key),
        "caller string, block int, ends bigint, count bigint",
    )
    return scan_sorted(
        cut.join(entered, keys).select(*keys, "at_ms", "request_id", "ends", "count"), keys, ["at_ms", "request_id"],
        lambda _: Resumed(limit, window_ms), "caller string, request_id bigint, at_ms bigint, allowed boolean",
    )


def request_limiter(requests: DataFrame, limit: int, window_ms: int, block: int = BLOCK) -> DataFrame:
    """caller, request_id, at_ms, allowed - in order of time, then id, per caller.

    ``requests`` has caller, request_id and at (timestamp). The state of a caller is two
    numbers, streamed past its sorted requests. A caller with more than ``block`` requests, and
    more than one in SHARE of all, is cut into blocks by time; each block tells where it leads
    from any open window, and only these steps are put in a row. Requests without a time are
    allowed and open no window. Callers that are null are one caller.
    """
    timed = requests.select("caller", F.unix_millis("at").alias("at_ms"), "request_id")
    counted = settle(timed.groupBy("caller").agg(F.count("at_ms").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.filter((F.col("n") > block) & (F.col("n") * SHARE > total) & F.col("caller").isNotNull())
    rows = hot.agg(F.sum("n")).first()[0] or 0
    whole = timed
    if rows:
        named = F.broadcast(hot.select("caller"))
        split = timed.filter("at_ms is not null").join(named, "caller", "left_semi")
        whole = timed.filter("at_ms is not null").join(named, "caller", "left_anti").unionByName(timed.filter("at_ms is null"))
    answers = scan_sorted(
        whole, ["caller"], ["at_ms", "request_id"], lambda _: Window(limit, window_ms),
        "caller string, request_id bigint, at_ms bigint, allowed boolean",
    )
    return answers.unionByName(_in_blocks(split, rows // block + 1, limit, window_ms)) if rows else answers
