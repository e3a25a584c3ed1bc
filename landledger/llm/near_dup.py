"""Near-duplicates by bottom-k sketches: inverted lists of retained values, union-sketch estimate, exact Jaccard.

One hash function makes the shingles of a text numbers; the sketch of a text is its k
smallest. Two texts with enough in common retain many values in common, so each is listed
only under its rarest few (in one order for all texts), as many as it takes to meet.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landledger.llm.shared import HOT_SHARE, components, join_on_hot, only_with, without
from landledger.session import settle

KEPT_VALUES = 128
PERCENT = 80
SHINGLE = 4
#: Chance that a pair just at the threshold shares fewer values than is counted on.
MISS = 1e-9
#: Retained values are ordered by how often any value of their group (leading bits) is retained.
GROUP_BITS = 16
#: Members of a star that are compared in one cell with those of another block.
BLOCK = 512

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The sorted distinct 64-bit hashes of a text's shingles; words are hashed once each."""

    def __init__(self, size: int = SHINGLE, kept_words: int = 200_000):
        self.size, self.kept_words, self.known = size, kept_words, {}

    def hashes(self, text: str) -> np.ndarray:
        # Lower-casing bytes changes A-Z alone, and blanks are bytes of their own in UTF-8.
        words, known = WORD.findall(text.encode("utf-8", "surrogatepass").lower()), self.known
        if len(known) > self.kept_words:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), "uint64", len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.hashes(text or "")
        if not len(h):
            return h
        n = min(self.size, len(h))
        total = np.full(len(h) - n + 1, n, "uint64")
        for i in range(n):
            total = _mixed(total * np.uint64(_FACTORS[i % 5]) + h[i:len(h) - n + 1 + i])
        return np.unique(total)


def least_shared(n: int, kept: int, percent: int) -> int:
    """Values that the sketch of a set of n shares with that of any set it is linked with."""
    exact = -(-percent * n // 100)
    # A partner has at most n * 100 / percent values; up to ``kept`` both sketches are whole sets.
    return exact if n * 100 <= kept * percent else _tail(kept, percent)


_TAILS: dict[tuple[int, int], int] = {}


def _tail(kept: int, percent: int) -> int:
    """Largest t with P(fewer than t of ``kept`` draws are shared) <= MISS. The smallest ``kept``
    values of a union are a draw without replacement, which strays less than the binomial one."""
    if (kept, percent) not in _TAILS:
        p, total, t = percent / 100, 0.0, 0
        while total <= MISS:
            total += math.comb(kept, t) * p**t * (1 - p) ** (kept - t)
            t += 1
        _TAILS[kept, percent] = max(1, t - 1)
    return _TAILS[kept, percent]


def unlike(shared: np.ndarray, union: np.ndarray, percent: int) -> np.ndarray:
    """Where ``shared`` of ``union`` values drawn from two sets' union are too few for a link.

    By Hoeffding's bound a linked pair is so taken with a chance of MISS at most.
    """
    slack = np.sqrt(-math.log(MISS) / 2 / np.maximum(union, 1))
    return shared < union * (percent / 100 - slack)


def _arrow(run: Callable[[list], Iterator[tuple]], types: list) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function on columns that yields rows, as one on Arrow batches."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*run(batch))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], [f"c{i}" for i in range(len(types))])

    return over


def sketches(docs: DataFrame, kept: int = KEPT_VALUES, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (shingles), c1 and c2 (128 bits that tell sets apart), sketch (its smallest values)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(t.as_py())
                d = xxhash.xxh3_128_digest(s.tobytes())
                yield key, len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), s[:kept].tobytes()

        yield from _arrow(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])(batches)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, c1 long, c2 long, sketch binary")


def _group_counts(sketched: DataFrame) -> np.ndarray:
    """How many retained values fall into each group: 2 ** GROUP_BITS numbers, whatever the corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**GROUP_BITS, "int64")
        for batch in batches:
            for s in batch.column(0).to_pylist():
                np.add.at(total, np.frombuffer(s, "uint64") & np.uint64(2**GROUP_BITS - 1), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["g", "n"])

    counts = np.zeros(2**GROUP_BITS, "int64")
    for g, n in sketched.select("sketch").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n")).collect():
        counts[g] = n
    return counts


def listed(sketched: DataFrame, counts: np.ndarray, kept: int = KEPT_VALUES, percent: int = PERCENT) -> DataFrame:
    """value, node: every set (c1, n, sketch) under the rarest of its retained values.

    Of two sets that share t retained values, each has one of them among all its values but t - 1.
    """
    shared = sketched.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            values, nodes = [], []
            for node, n, s in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(s, "uint64")
                rare = np.lexsort((v, often[v & np.uint64(2**GROUP_BITS - 1)]))[:len(v) - least_shared(n, kept, percent) + 1]
                values.append(v[rare].view("int64"))
                nodes.append(np.full(len(rare), node, "int64"))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (values, nodes)], ["value", "node"])

    return sketched.select("c1", "n", "sketch").mapInArrow(run, "value long, node long")


def shared_lists(entries: DataFrame, counts: np.ndarray) -> DataFrame:
    """value, node, once each, of the values that more than one set is listed under.

    Values of groups with more than a ``HOT_SHARE``-th of all are counted before they are
    joined; there are fewer such groups than that. Of the others none can fill a task, so
    they are shuffled once and looked at together.
    """
    often = [int(g) for g in np.flatnonzero(counts * HOT_SHARE > counts.sum())]
    hot = F.col("value").bitwiseAND(2**GROUP_BITS - 1).isin(often)
    of_value = Window.partitionBy("value")
    cold = (
        entries.filter(~hot).withColumns({"low": F.min("node").over(of_value), "high": F.max("node").over(of_value)})
        .filter("low <> high").select("value", "node")
    )
    some = entries.filter(hot)
    counted = settle(
        some.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
        .filter("low <> high").select("value", "n")
    )
    return cold.unionByName(join_on_hot(some, counted, ["value"], "n").select("value", "node")).distinct()


def stars(lists: DataFrame) -> DataFrame:
    """leader, node: every set of a list with the leader of the list, both by c1.

    Leader is the set with the most values in such lists: of near copies the one that the
    others were made from. Any two sets of a list are in the star of its leader.
    """
    weight = lists.groupBy("node").agg(F.count("*").alias("weight"))
    leaders = (
        lists.join(weight, "node").groupBy("value")
        .agg(F.max(F.struct("weight", "node")).alias("top"), F.count("*").alias("n"))
        .select("value", F.col("top.node").alias("leader"), "n")
    )
    return join_on_hot(lists, settle(leaders), ["value"], "n").filter("leader <> node").select("leader", "node").distinct()


class Cell:
    """The sets of a cell of a star, leader first, by their sketches and, if given, as a whole."""

    def __init__(self, docs: list, blocks: list[int], sizes: list[int], sketches: list[np.ndarray], kept: int, percent: int, sets: list[np.ndarray] | None = None):
        self.docs, self.blocks, self.sizes, self.percent = docs, np.array(blocks), np.array(sizes), percent
        self.sketches, self.short = sketches, self._index(sketches)
        self.whole = self._index(sets) if sets else None
        #: Up to here a sketch holds all values of its set.
        top = np.iinfo("uint64").max
        self.reach = np.array([s[-1] if n > kept else top for s, n in zip(sketches, sizes)], "uint64")
        self.part = np.arange(len(docs))
        self.members = self.part > 0

    @staticmethod
    def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        values, places = np.unique(np.concatenate(sets), return_inverse=True)
        return places, np.cumsum([0] + [len(s) for s in sets])[:-1], len(values)

    def _shared(self, index: tuple[np.ndarray, np.ndarray, int], x: int) -> np.ndarray:
        places, starts, n = index
        end = starts[x + 1] if x + 1 < len(starts) else len(places)
        mark = np.zeros(n, "int32")
        mark[places[starts[x]:end]] = 1
        return np.add.reduceat(mark[places], starts)

    def likely(self, x: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` (a mask) that the union of both sketches does not rule out."""
        sizes, n = self.sizes, self.sizes[x]
        some = np.flatnonzero(among & (np.minimum(sizes, n) * 100 >= self.percent * np.maximum(sizes, n)))
        if not len(some):
            return some
        shared = self._shared(self.short, x)[some]
        reach = np.minimum(self.reach[some], self.reach[x])
        own = np.searchsorted(self.sketches[x], reach, "right")
        other = np.array([np.searchsorted(self.sketches[y], r, "right") for y, r in zip(some, reach)])
        return some[~unlike(shared, own + other - shared, self.percent)]

    def near(self, x: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` that are linked with x, by their whole sets."""
        some = self.likely(x, among)
        if not len(some):
            return some
        both = self._shared(self.whole, x)[some]
        return some[both * 100 >= self.percent * (self.sizes[x] + self.sizes[some] - both)]

    def _meets(self, x: int, alone: bool) -> np.ndarray:
        """The members that x meets here: its own block in a cell of one, else the other block."""
        return self.members if alone else self.members & (self.blocks != self.blocks[x])

    def candidates(self, alone: bool) -> Iterator[object]:
        """The members that may be linked with the leader or with another member."""
        seen = np.zeros(len(self.docs), bool)
        seen[self.likely(0, self.members)] = True
        for x in np.flatnonzero(self.members & ~seen):
            some = self.likely(x, self._meets(x, alone))
            if len(some := some[some != x]):
                seen[some] = seen[x] = True
        return (self.docs[x] for x in np.flatnonzero(seen))

    def links(self, alone: bool) -> Iterator[tuple[object, object]]:
        """Links that join parts. Only those apart from the leader's part are compared with the rest."""
        yield from self._join(0, self.near(0, self.members))
        for x in np.flatnonzero(self.members & (self.part != self.part[0])):
            yield from self._join(x, self.near(x, self._meets(x, alone) & (self.part != self.part[x])))

    def _join(self, x: int, near: np.ndarray) -> Iterator[tuple[object, object]]:
        for y in near:
            if self.part[x] != self.part[y]:
                self.part[self.part == self.part[y]] = self.part[x]
                yield self.docs[x], self.docs[y]


def in_cells(
    rows: DataFrame, star: DataFrame, what: list[str], work: Callable[[tuple, list[tuple]], list[tuple]], names: list[str], block: int = BLOCK
) -> DataFrame:
    """work(key, rows) over the cells of each star (leader, node); ``rows`` are doc_id and ``what``.

    A key is (leader, first, second), a row (block, doc_id, *what), the leader's with block -1.
    A star of more than ``block`` members is dealt out: every two blocks meet in a cell of
    their own, with the leader. The result has the columns ``names``, whole numbers.
    """
    blocks = settle(star.groupBy("leader").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    sized = join_on_hot(star, blocks, ["leader"], "n").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    members = sized.select("leader", F.col("node").alias("of"), "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select(
        "leader", "of", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second")
    )
    heads = blocks.select("leader", F.explode(F.expr("sequence(0, blocks - 1)")).alias("first"), "blocks").select(
        "leader", F.col("leader").alias("of"), F.lit(-1).alias("own"), "first", F.explode(F.expr("sequence(first, blocks - 1)")).alias("second")
    )
    keys = ["leader", "first", "second"]
    dealt = rows.join(members.unionByName(heads), F.col("doc_id") == F.col("of")).select(*keys, "own", "doc_id", *what)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple[tuple, list[tuple]]]:
            key, held = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if key != row[:3]:
                        if held:
                            yield key, held
                        key, held = row[:3], []
                    held.append(row[3:])
            if held:
                yield key, held

        for key, held in cells():
            if found := work(key, held):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "own", "doc_id").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def likely_stars(sketched: DataFrame, star: DataFrame, kept: int, percent: int, block: int = BLOCK) -> DataFrame:
    """The (leader, node) of ``star`` that may be linked within it, by the sketches (doc_id, n, sketch)."""

    def work(key: tuple, rows: list[tuple]) -> list[tuple]:
        blocks, docs, sizes, raw = zip(*rows)
        cell = Cell(docs, blocks, sizes, [np.frombuffer(s, "uint64") for s in raw], kept, percent)
        return [(key[0], doc) for doc in cell.candidates(key[1] == key[2])]

    return in_cells(sketched, star, ["n", "sketch"], work, ["leader", "node"], block).filter("leader <> node").distinct()


def links(docs: DataFrame, star: DataFrame, kept: int, percent: int, shingle: int, block: int = BLOCK) -> DataFrame:
    """a, b: links among the documents (doc_id, text) of each star, enough to join all that are linked."""
    shingles: list[Shingler] = []

    def work(key: tuple, rows: list[tuple]) -> list[tuple]:
        if not shingles:
            shingles.append(Shingler(shingle))
        # Another row of the same doc_id may have no shingle; it is linked with nothing.
        held = [(block, doc, own) for block, doc, text in rows if len(own := shingles[0](text))]
        if not held or held[0][0] != -1:
            return []
        blocks, docs, sets = zip(*held)
        cell = Cell(docs, blocks, [len(s) for s in sets], [s[:kept] for s in sets], kept, percent, sets)
        return list(cell.links(key[1] == key[2]))

    named = settle(star.select(F.col("leader").alias("doc_id")).unionByName(star.select(F.col("node").alias("doc_id"))).distinct())
    return in_cells(only_with(docs, named, ["doc_id"]), star, ["text"], work, ["a", "b"], block)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, kept: int = KEPT_VALUES
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; doc_id must be a whole number.

    Two documents are linked if 100 * |both| >= percent * |either| for their sets of distinct
    shingles of ``shingle`` words (a shorter text is one shingle). component_id is the smallest
    doc_id reachable over links, kept says that it is the row's own.

    Null texts and texts without words have no shingle and are linked with nothing, and so are
    rows without doc_id, whose component_id is null. Equal sets are one class and are compared
    once. Rows that repeat a doc_id are one document with the links of all of them. Other
    columns are ignored. No rows give no rows.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = settle(sketches(named, kept, shingle))
    some = sketched.filter("n > 0 and doc_id is not null")
    classes = settle(some.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    counts = _group_counts(some)
    lists = settle(shared_lists(listed(some, counts, kept, percent), counts))
    leading = classes.select(F.col("c1").alias("leader"), F.col("rep").alias("leader_doc"))
    following = classes.select(F.col("c1").alias("node"), F.col("rep").alias("node_doc"))
    star = settle(
        stars(lists).join(leading, "leader").join(following, "node")
        .select(F.col("leader_doc").alias("leader"), F.col("node_doc").alias("node")).filter("leader <> node").distinct()
    )
    likely = settle(likely_stars(some.select("doc_id", "n", "sketch"), star, kept, percent))
    joined = components(links(named.filter("doc_id is not null"), likely, kept, percent, shingle))
    # A document whose rows differ has more than one class; they are joined like linked ones.
    grouped = settle(
        classes.join(joined, F.col("rep") == F.col("node"), "left")
        .select("c1", "c2", F.coalesce("component", "rep").alias("component_id"), "copies")
    )
    found = join_on_hot(some.select("doc_id", "n", "c1", "c2"), grouped, ["c1", "c2"], "copies").select("doc_id", "n", "component_id")
    apart = sketched.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(apart).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns."""
    found = near_duplicates(docs, doc_id, text, **options)
    gone = settle(found.filter("not kept").select("doc_id").distinct())
    return without(docs.select(F.col(doc_id).alias("doc_id"), F.struct("*").alias("rest")), gone, ["doc_id"]).select("rest.*")
