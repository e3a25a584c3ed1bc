"""Fuzzy place joins.

Khasra and khata numbers such as ``29`` recur in every village, so a join on the
number alone would compare a whole country with itself. Places are matched first,
as distinct names: a blocking step proposes name pairs, the similarity test keeps
the true ones, and the resulting pair table turns every record-level join into an
equi-join on (number, village, district). Similarity is not transitive, so pairs
are never collapsed into clusters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.functions.names import same_place
from landledger.functions.text import folded, let, name_key, place_key, trim
from landledger.session import settle

# Names up to this length are blocked by their pieces, longer ones by their rarest runs of GRAM letters:
# the pieces of a long name get too many, the runs of a short one tell too little.
PIECE_LIMIT, GRAM = 48, 4

KEYS = {
    "khasra_number": {"khasra_key": folded("khasra_number"), "khasra_trim": trim("coalesce(khasra_number, '')")},
    "khata_number": {"khata_key": folded("khata_number")},
    "village": {"village_key": place_key("village")},
    "district": {"district_key": place_key("district")},
    "owner_name": {"owner_key": name_key("owner_name")},
}


def with_keys(df: DataFrame) -> DataFrame:
    """Add the comparison keys of a record, source row or parcel.

    Only keys whose column is present are added; unused ones are pruned by the optimizer.
    """
    new = {k: F.expr(e) for column, made in KEYS.items() if column in df.columns for k, e in made.items()}
    return df.withColumns(new)


def _edits(length: str) -> str:
    """Edits a pair may have when its longer name has this length."""
    return f"({length} * 15 div 100)"


def _without_one(text: str) -> str:
    return (
        f"transform(sequence(1, length({text})), "
        f"j -> concat(substring({text}, 1, j - 1), substring({text}, j + 1)))"
    )


def _pieces(length: str) -> str:
    """The near-equal pieces a name of this length is cut into: struct(i, start, size)."""
    return let(
        f"int({_edits(length)} div 2 + 1)",
        "m",
        f"transform(sequence(0, m - 1), i -> struct(i, "
        f"int(i * int({length} div m) + least(i, int({length} % m))) as start, "
        f"int({length} div m) + if(i < {length} % m, 1, 0) as size))",
    )


def _index_keys(name: str) -> str:
    """Block keys of a name in its role as the longer one of a pair."""
    length = f"length({name})"
    of_piece = let(
        f"substring({name}, p.start + 1, p.size)",
        "s",
        f"transform(array_append({_without_one('s')}, s), v -> concat_ws('|', {length}, p.i, v))",
    )
    return (
        f"if({_edits(length)} = 0, array(concat_ws('|', {length}, 0, {name})), "
        f"array_distinct(flatten(transform({_pieces(length)}, p -> {of_piece}))))"
    )


def _probe_keys(name: str) -> str:
    """Block keys of a name in its role as the shorter one, for every longer length in reach."""
    # One edit apart means: equal, or equal after dropping one character on the
    # longer side or one on both sides.
    variants = (
        f"case when length(t) < p.size then array(t) when length(t) = p.size then "
        f"array_append({_without_one('t')}, t) else {_without_one('t')} end"
    )
    first, last = f"greatest(0, p.start - {_edits('n')})", f"least(p.start + {_edits('n')}, length({name}))"
    cuts = (
        f"if({_edits('n')} < 2, array({name}), array_distinct(filter(flatten(transform("
        f"if({first} <= {last}, sequence({first}, {last}), cast(array() as array<bigint>)), "
        f"c -> transform(array(p.size - 1, p.size, p.size + 1), z -> substring({name}, int(c) + 1, z)))), "
        f"t -> abs(length(t) - p.size) <= 1)))"
    )
    for_length = (
        f"if({_edits('n')} = 0, array(concat_ws('|', n, 0, {name})), flatten(transform({_pieces('n')}, "
        f"p -> flatten(transform({cuts}, t -> transform({variants}, v -> concat_ws('|', n, p.i, v)))))))"
    )
    lengths = (
        f"filter(sequence(length({name}), int(length({name}) * 100 div 85) + 1), "
        f"n -> n - {_edits('n')} <= length({name}))"
    )
    return f"array_distinct(flatten(transform({lengths}, n -> {for_length})))"


def long_candidates(names: DataFrame) -> DataFrame:
    """Pairs (kind, a, b) with b beyond PIECE_LIMIT and a no longer, every similar one among them.

    An edit changes GRAM runs of letters at most, so of the runs of the longer name (with their
    number where they recur) all but GRAM an edit are in the shorter one too. With runs in one
    order for all names, both have a common one among their first GRAM an edit and one; the order
    is by how many names hold a run, so that these are the rarest. Keys grow in proportion to the
    length of a name, and nothing is compared for its length alone.
    """
    run = f"substring(name, i, {GRAM})"
    runs = (
        names.selectExpr("kind", "name", f"explode(transform(sequence(1, length(name) - {GRAM - 1}), i -> {run})) as run")
        .groupBy("kind", "name", "run").agg(F.count("*").alias("n"))
        .selectExpr("kind", "name", "run", "explode(sequence(1, int(n))) as copy")
    )
    held = runs.groupBy("kind", "run", "copy").agg(F.count("*").alias("holders"))
    # The longest partner decides how many edits there may be.
    first = f"{GRAM} * {_edits('int(length(name) * 100 div 85 + 1)')} + 1"
    rarest = (
        runs.join(held.filter("holders > 1"), ["kind", "run", "copy"], "left")
        .groupBy("kind", "name")
        .agg(F.array_sort(F.collect_list(F.expr("struct(coalesce(holders, 1) as holders, run, copy)"))).alias("runs"))
        .selectExpr("kind", "name", f"inline(filter(slice(runs, 1, int({first})), r -> r.holders > 1))")
    )
    a = rarest.selectExpr("kind", "run", "copy", "name as a")
    b = rarest.filter(F.length("name") > PIECE_LIMIT).selectExpr("kind", "run", "copy", "name as b")
    reach = "a <> b and length(a) <= length(b) and length(b) - length(a) <= " + _edits("length(b)")
    return a.join(b, ["kind", "run", "copy"]).filter(reach).select("kind", "a", "b").distinct()


def similar_names(names: DataFrame) -> DataFrame:
    """All ordered pairs (kind, a, b) of similar distinct names, each with itself included.

    ``names`` has kind and name; only names of one kind are paired. Blocking is exact:
    with k edits allowed on the longer name it is cut into k//2 + 1 pieces, one of which
    must survive with at most one edit and a shift of at most k. Single-edit pieces are
    met by dropping one character, so a block only ever holds names that nearly share a
    piece. Long names meet by their rarest runs of letters, which is exact too.
    """
    distinct = names.filter(F.length("name") > 0).distinct()
    short = distinct.filter(F.length("name") <= PIECE_LIMIT)
    long = distinct.filter(F.length("name") > PIECE_LIMIT - 10)
    similar = f"length(a) <= length(b) and a <> b and {same_place('a', 'b')}"

    index = short.selectExpr("kind", "name as b", f"explode({_index_keys('name')}) as block")
    probe = short.selectExpr("kind", "name as a", f"explode({_probe_keys('name')}) as block")
    close = probe.join(index, ["kind", "block"]).filter(similar).select("kind", "a", "b")

    far = long_candidates(long).filter(similar).select("kind", "a", "b")
    both_ways = close.unionByName(far).selectExpr("kind", "inline(array(struct(a, b), struct(b as a, a as b)))")
    return distinct.selectExpr("kind", "name as a", "name as b").unionByName(both_ways).distinct()


def place_pairs(*frames: DataFrame) -> DataFrame:
    """Ordered pairs of matching places over all frames.

    Columns: village_key, district_key, other_village, other_district. Each frame must
    carry ``village_key`` and ``district_key``. Both names are matched apart and then
    joined, so a village name found in every district never pairs up across them. The
    table is small next to the data and read by several joins, so it is worked out once.
    """
    # Read the data once; everything after works on the distinct places alone.
    places = settle(
        reduce(DataFrame.unionByName, [f.select("village_key", "district_key") for f in frames])
        .filter("village_key <> '' and district_key <> ''").distinct()
    )
    alike = settle(
        similar_names(
            places.selectExpr("inline(array(struct('v' as kind, village_key as name), struct('d' as kind, district_key as name)))")
        )
    )
    villages = alike.filter("kind = 'v'").selectExpr("a as village_key", "b as other_village")
    districts = alike.filter("kind = 'd'").selectExpr("a as district_key", "b as other_district")
    reached = places.join(villages, "village_key").join(districts, "district_key")
    known = places.select(
        F.col("village_key").alias("other_village"), F.col("district_key").alias("other_district")
    )
    return settle(
        reached.join(known, ["other_village", "other_district"], "left_semi")
        .select("village_key", "district_key", "other_village", "other_district")
    )


def fuzzy_place_join(
    left: DataFrame,
    right: DataFrame,
    number: str = "khasra_key",
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Inner join: number exact, village and district similar.

    Both frames come from :func:`with_keys`. Right columns keep their names, so the
    caller selects what it needs first; the right key columns are dropped. Blank
    numbers and blank places match nothing.
    """
    pairs = place_pairs(left, right) if pairs is None else pairs
    reached = left.filter(F.col(number) != "").join(pairs, ["village_key", "district_key"])
    target = right.filter(F.col(number) != "").withColumnsRenamed(
        {"village_key": "other_village", "district_key": "other_district"}
    )
    return reached.join(target, [number, "other_village", "other_district"]).drop(
        "other_village", "other_district"
    )
