"""Near-duplicate documents: fast similarity sketches, banding and verification on full shingle sets.

1. Each text becomes a set of five-word shingles, a sketch and 32 band keys.  Equal sets form classes; only a class's
   smallest id goes on, so copies are never expanded into pairs.
2. Ids that share a band key are candidates.  In each bucket one member, the one that meets most others over all bands,
   is compared with all the rest on full sets; hubs are split by salt so that no task gathers a bucket.
3. Links give components.  Pairs of a bucket inside one component need no comparison.  Across components, what both share
   with a common centre bounds what they can share with each other; pairs that the bound rules out are left out, which is
   exact.  The remaining candidates are compared on full sets, in rounds of one member of each bucket with the rest, in
   which components grow together, and at last pair by pair where they have not.
4. Components of all links, with classes put back.

A pair at the threshold is missed by all bands with a chance of 5 in a million.  Every candidate pair is decided on full sets
of 51-bit shingle hashes: two different shingles of one pair of texts of 1,000 shingles each have the same hash with a
chance of 1 in two billion.

Defined cases: null texts and texts without words have an empty set, link with nothing and are their own component; texts
of fewer than five words are one shingle; rows that repeat an id count as one document in links and get one answer each;
null ids are kept as their own component (null, kept); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.operators.components import connected_components

from . import shingles as S
from .buffers import lean, raw, slices
from .store import materialise

PERCENT = 75
#: Members that one task compares with a bucket's hub at a time.
FANOUT = 64
#: Rounds in which each bucket of candidates across components has one member compared with the rest.
ROUNDS = 3
SKETCHES = "id long, n int, d1 long, d2 long, keys array<long>"
SETS = "id long, n int, shingles binary"
#: both: how many shingles id and hub share.
COMPARED = "id long, hub long, both int, n int, hub_n int"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            for at in range(0, part.num_rows, 2048):
                yield part.slice(at, 2048)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _parts(batches):
        held, sizes = S.shingle_sets(*raw(rows.column("text")))
        d1, d2 = S.digests(held, sizes)
        keys = S.band_keys(S.sketches(held, sizes))
        offsets = np.arange(len(sizes) + 1, dtype=np.int32) * S.BANDS
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), pa.array(sizes, pa.int32()), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["id", "n", "d1", "d2", "keys"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _parts(batches):
        held, sizes = S.shingle_sets(*raw(rows.column("text")))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        data = [held[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["id", "n", "shingles"])


def _beside_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(id, hub, its set, the hub's set) from hub, salt, member, id, shingles, sorted, each hub's set before its members'."""
    at, hub = None, np.zeros(0, np.int64)
    for batch in batches:
        data, offsets = raw(batch.column("shingles"))
        keys = zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "member", "id")), strict=True)
        for (h, salt, member, x), lo, hi in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = np.frombuffer(data[lo:hi].tobytes(), np.int64)
            if not member:
                at, hub = (h, salt), own
            elif at != (h, salt):
                raise RuntimeError("a member came without its hub")
            else:
                yield x, h, own, hub


def _in(own: np.ndarray, hub: np.ndarray) -> np.ndarray:
    if not len(hub):
        return np.zeros(len(own), bool)
    return hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COMPARED for every member."""
    rows: list[tuple[int, int, int, int, int]] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["id", "hub", "both", "n", "hub_n"])

    for x, h, own, hub in _beside_hubs(batches):
        rows.append((x, h, int(_in(own, hub).sum()), len(own), len(hub)))
        if len(rows) == 4096:
            yield out()
            rows.clear()
    if rows:
        yield out()


def _extras(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hub, shingle) for every member's shingles that its hub lacks."""
    for x, h, own, hub in _beside_hubs(batches):
        more = own[~_in(own, hub)]
        if len(more):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(more), x)), pa.array(np.full(len(more), h)), pa.array(more)], ["id", "hub", "shingle"])


def beside_hubs(pairs: DataFrame, sets: DataFrame, function, schema: str) -> DataFrame:
    """function over pairs (id, hub) with both sets.  A hub's set goes once to each FANOUT of its members."""
    wide = pairs.groupBy("hub").agg(F.ceil(F.count("*") / FANOUT).cast("int").alias("salts"))
    salted = pairs.join(wide, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), "id")
    hubs = wide.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("hub").alias("id"))
    rows = salted.unionByName(hubs).join(sets.select("id", "shingles"), "id")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(lean(function), schema)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return beside_hubs(pairs, sets, _compare, COMPARED)


def _linked(rows: DataFrame) -> DataFrame:
    return rows.filter(f"100 * both >= {PERCENT} * (n + hub_n - both)").select(F.col("id").alias("a"), F.col("hub").alias("b"))


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """(id, hub): each bucket's members with the one of them that meets most others over all its buckets."""
    met = buckets.groupBy("id").agg(F.sum("size").alias("met"))
    best = buckets.join(met, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("best"))
    hubs = best.select("key", (-F.col("best.minus")).alias("hub"))
    return buckets.join(hubs, "key").filter("id <> hub").select("id", "hub").distinct()


def _around_centres(first: DataFrame, buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, hub, part): ids whose hubs lie in one component, beside the one of that component that meets most others.

    Only where ids of other components are among them; one centre for each component, however many hubs it has.
    """
    label = lambda df, c: df.join(parts.select(F.col("node").alias(c), F.col("component")), c, "left").withColumn(f"{c}_part", F.coalesce("component", c)).drop("component")
    met = first.select("id", "hub").union(first.select("hub", "hub")).distinct()
    met = label(label(met, "id"), "hub").select("id", "id_part", F.col("hub_part").alias("around")).distinct()
    mixed = met.groupBy("around").agg(F.min("id_part").alias("p"), F.max("id_part").alias("q")).filter("p <> q").select("around")
    met = materialise(met.join(mixed, "around"), "near-met")
    many = buckets.groupBy("id").agg(F.sum("size").alias("met"))
    centre = met.filter("id_part = around").join(many, "id").groupBy("around").agg(F.max_by("id", F.struct("met", (-F.col("id")).alias("minus"))).alias("hub"))
    return met.join(centre, "around").filter("id <> hub").select("id", "hub", F.col("id_part").alias("part"))


def _buckets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, side, id, part, both, rest, n): ids beside one centre that may be similar to another of their bucket.

    rows: id, hub, both, n, hub_n, part.  Let x have s of its n shingles in common with the centre and e = n - s others.
    Two ids share min(s, s') + min(e, e') shingles at most, and min(s, s') at most if none of the others.  As two links to
    the centre would have joined them, one of both, x, is not linked with it.  So either x's partner is small enough for
    s alone to do, or both share at least `need` of their others, and then also one of the rarest e - need + 1 of either.
    Side 0: any two of a bucket, which share one of their others; buckets of equal members are one.  Sides 1 and 2: x and
    the partners of one size.
    """
    k, all_of = PERCENT, 100 + PERCENT
    least = rows.groupBy("hub").agg(F.min("n").alias("least"))
    rows = rows.join(least, "hub").withColumns({
        "linked": F.expr(f"100 * both >= {k} * (n + hub_n - both)"),
        "rest": F.col("n") - F.col("both"),
        "reach": F.expr(f"cast(floor(({all_of} * both - {k} * n) / {k}) as int)"),
        "need": F.expr(f"cast(ceil({k} * (n + greatest(least, ceil({k} * n / 100))) / {all_of}) as int) - both"),
    })  # reach: the largest partner for which s alone may do
    rows = materialise(rows, "near-beside")
    extras = materialise(beside_hubs(rows.filter("rest >= need").select("id", "hub"), sets, _extras, "id long, hub long, shingle long"), "near-extras")
    df = extras.join(rows.select("id", "hub", "part"), ["id", "hub"]).groupBy("hub", "shingle").agg(F.count("*").alias("df"), F.min("part").alias("p"), F.max("part").alias("q"))
    rank = F.row_number().over(Window.partitionBy("hub", "id").orderBy("df", "shingle"))
    ranked = extras.join(df, ["hub", "shingle"]).withColumn("rank", rank).filter("p <> q")
    columns = ["id", "part", "both", "rest", "n"]
    ranked = materialise(ranked.join(rows.drop("least", "hub_n", "reach"), ["id", "hub"]).filter("rank <= rest - greatest(need, 1) + 1").select("hub", "shingle", *columns), "near-ranked")
    members = ranked.groupBy("hub", "shingle").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("m2"))
    one_each = members.filter("size > 1").groupBy("hub", "size", "m1", "m2").agg(F.min("shingle").alias("shingle")).select("hub", "shingle")
    share = ranked.join(one_each, ["hub", "shingle"]).select(F.xxhash64(F.lit(0), "hub", "shingle").alias("key"), F.lit(0).alias("side"), *columns)
    fit = rows.filter(f"100 * reach >= {k} * n")
    sizes = fit.groupBy("hub", F.col("n").alias("size")).agg(F.max("reach").alias("most"))
    lone = rows.filter("not linked").alias("x").join(sizes.alias("s"), F.expr(f"x.hub = s.hub and s.size <= x.reach and s.most >= x.n and 100 * s.size >= {k} * x.n")).select("x.*", "s.size")
    lone = lone.select(F.xxhash64(F.lit(1), "hub", "size").alias("key"), F.lit(1).alias("side"), *columns)
    partners = fit.select(F.xxhash64(F.lit(1), "hub", "n").alias("key"), F.lit(2).alias("side"), *columns).join(lone.select("key").distinct(), "key", "left_semi")
    return share.unionByName(lone).unionByName(partners)


def _pairs_of(x: DataFrame, y: DataFrame, condition: str) -> DataFrame:
    """Pairs (id, part, hub, hub_part) of buckets' rows in different parts whose bounds allow a link."""
    bound = f"{100 + PERCENT} * (least(x.both, y.both) + least(x.rest, y.rest)) >= {PERCENT} * (x.n + y.n)"
    met = x.alias("x").join(y.alias("y"), F.expr(f"x.key = y.key and x.part <> y.part and (x.side = 0 or x.side <> y.side) and {bound} and {condition}"))
    return met.select(F.greatest("x.id", "y.id").alias("id"), F.least("x.id", "y.id").alias("hub"), F.when(F.expr("x.id > y.id"), F.col("x.part")).otherwise(F.col("y.part")).alias("part"), F.when(F.expr("x.id > y.id"), F.col("y.part")).otherwise(F.col("x.part")).alias("hub_part")).distinct()


def _cross_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between ids beside one centre that lie in different components, enough to join all that belong together.

    In each of ROUNDS rounds one member of every bucket is compared with those of other components; links join
    components, and buckets with one component left need nothing more.  So a family far from the centre is joined by as
    many comparisons as it has members.  Then all pairs that are still in different components and within the bounds are
    compared, which is exact whatever the rounds have done.
    """
    buckets = materialise(_buckets(rows, sets), "near-cross")
    links = []
    for turn in range(ROUNDS):
        chosen = buckets.groupBy("key").agg(F.min_by(F.struct(*buckets.columns), F.xxhash64(F.lit(turn), "id")).alias("c")).select("c.*")
        pairs = materialise(_pairs_of(buckets, chosen, "x.id <> y.id"), "near-turn")
        found = materialise(_linked(compared(pairs.select("id", "hub"), sets)), "near-turn-links")
        if found.isEmpty():
            break
        links.append(found)
        joined = found.join(pairs, F.expr("a = id and b = hub")).select(F.col("part").alias("a"), F.col("hub_part").alias("b")).distinct()
        parts = connected_components(joined, lambda df: materialise(df, "near-part"))
        buckets = buckets.join(parts, F.col("part") == F.col("node"), "left").withColumn("part", F.coalesce("component", "part")).drop("node", "component")
        mixed = buckets.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("key")
        buckets = materialise(buckets.join(mixed, "key", "left_semi"), "near-cross")
    links.append(materialise(_linked(compared(_pairs_of(buckets, buckets, "x.id < y.id").select("id", "hub"), sets)), "near-second"))
    return reduce(DataFrame.unionByName, links)


def near_links(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Links (a, b) between class representatives, enough to give the true components."""
    reps = sketched.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.min_by("keys", "id").alias("keys"))
    bands = reps.select("id", F.explode("keys").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialise(bands.join(sizes.hint("shuffle_hash"), "key"), "near-buckets")
    wanted = buckets.select("id").distinct()
    sets = materialise(docs.join(wanted.hint("shuffle_hash"), "id", "left_semi").mapInArrow(lean(_sets), SETS), "near-sets")
    first = materialise(compared(_hub_pairs(buckets), sets), "near-first")
    parts = connected_components(_linked(first), lambda df: materialise(df, "near-part"))
    around = materialise(_around_centres(first, buckets, parts), "near-around")
    beside = materialise(compared(around.select("id", "hub"), sets).join(around, ["id", "hub"]), "near-centres")
    joined = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))  # stands for the first links
    return joined.unionByName(_linked(beside)).unionByName(_cross_links(beside, sets))


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept, class_id (smallest id with an equal set)."""
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sketched = materialise(docs.mapInArrow(lean(_sketch), SKETCHES), "near-sketch")
    parts = connected_components(near_links(docs, sketched), lambda df: materialise(df, "near-part"))
    classes = sketched.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("class_id"))
    classes = classes.join(parts, F.col("class_id") == F.col("node"), "left").select("d1", "d2", "n", "class_id", F.coalesce("component", "class_id").alias("part"))
    rows = sketched.join(classes, ["d1", "d2", "n"], "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("part", "id")))
    return rows.select(
        F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("class_id", "id").alias("class_id")
    )
