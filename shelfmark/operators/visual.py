"""Image pairs between products: equal files, near hashes, and a verdict for each pair of products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.contracts import IMAGE_HASHES, VISUAL_PAIRS, check_schema, conform, demand, repeated, violations
from shelfmark.functions.numbers import aspect_delta, hamming, long_of_hex
from shelfmark.sources.scratch import materialise


@dataclass(frozen=True)
class Limits:
    """(pHash distance, dHash distance, aspect difference) up to which a pair counts; products that may share a trusted file."""

    candidate: tuple[int, int, float] = (6, 10, 0.05)
    strong: tuple[int, int, float] = (4, 4, 0.02)
    very_strong: tuple[int, int, float] = (1, 1, 0.01)
    most_products: int = 20


def hamming_pairs(hashes: DataFrame, radius: int = 6, agreeing: int = 3) -> DataFrame:
    """(a, b, distance), a <= b, of distinct longs h at most radius bits apart, equal ones not paired.

    64 bits in radius + agreeing bands: hashes that differ in radius bits agree in `agreeing` bands at least, so an
    equi-join on every choice of that many bands finds every pair.  More bands make keys longer (21 bits of 64 by default,
    27 with four) and their choices more (84, 210): a row goes to each of them, but meets only 1 in 2^21 of the others
    there by chance.  Bits are compared before pairs are made distinct.  Both sides are dealt by key and merged: Spark takes
    the size of the hashes for that of their keys, 84 times as many, and would send these through the driver.
    """
    bands = radius + agreeing
    cuts = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << (z - a)) - 1) << a for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(bands), agreeing)]
    keys = F.transform(F.array(*map(F.lit, choices)), lambda mask: F.struct(mask.alias("mask"), F.col("h").bitwiseAND(mask).alias("bits")))
    split = hashes.select("h").distinct().select("h", F.explode(keys).alias("k")).select("h", "k.mask", "k.bits").hint("merge")
    a, b = split.alias("a"), split.alias("b")
    near = F.expr("a.mask = b.mask and a.bits = b.bits and a.h < b.h") & (hamming(F.col("a.h"), F.col("b.h")) <= radius)
    return a.join(b, near).select(F.col("a.h").alias("a"), F.col("b.h").alias("b"), hamming(F.col("a.h"), F.col("b.h")).alias("distance")).distinct()


def _oriented(l: str, r: str) -> list[Column]:  # noqa: E741
    """Columns of an image pair with the smaller product on the left."""
    first = F.col(f"{l}.id") < F.col(f"{r}.id")
    pick = lambda c, a, b: F.when(first, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    return [pick("id", l, r).alias("left_id"), pick("id", r, l).alias("right_id"), pick("relative_path", l, r).alias("left_path"), pick("relative_path", r, l).alias("right_path"), ((F.col(f"{l}.image_index") == 0) & (F.col(f"{r}.image_index") == 0)).alias("primary")]


def exact_pairs(images: DataFrame, most_products: int = 20) -> DataFrame:
    """Image pairs of one file in different products: left, right, paths, primary, trusted.

    A file of up to most_products products pairs all its images; one of more is common: each product's first path pairs
    with that of the smallest product only.
    """
    files = images.groupBy("file_sha256").agg(F.countDistinct("id").alias("products")).filter("products > 1")
    rows = images.join(files, "file_sha256")
    few, many = rows.filter(F.col("products") <= most_products), rows.filter(F.col("products") > most_products)
    trusted = few.alias("l").join(few.alias("r"), F.expr("l.file_sha256 = r.file_sha256 and l.relative_path < r.relative_path and l.id <> r.id")).select(*_oriented("l", "r"), F.lit(True).alias("trusted"))
    first = many.groupBy("file_sha256", "id").agg(F.min(F.struct("relative_path", "image_index")).alias("f")).select("file_sha256", "id", "f.*")
    least = first.groupBy("file_sha256").agg(F.min(F.struct("id", "relative_path", "image_index")).alias("m")).select("file_sha256", "m.*")
    star = least.alias("l").join(first.alias("r"), F.expr("l.file_sha256 = r.file_sha256 and l.id <> r.id")).select(*_oriented("l", "r"), F.lit(False).alias("trusted"))
    return trusted.unionByName(star)


#: Kinds of two perceptual hashes meet row by row up to so many pairs, beyond it in blocks of so many kinds.
HOT_PAIRS, BLOCK_KINDS = 1 << 12, 1 << 15
#: Kinds of a block that meet the other block at once.
TILE_KINDS = 16


def _near_in_blocks(links: DataFrame, kinds: DataFrame, radius: int) -> DataFrame:
    """(lk, rk, pd, dd): kinds of the links' two hashes (a, b, distance, na, nb) whose difference hashes are within radius.

    A hash that very many kinds share would bring them all together in one key.  Each block of its kinds is packed into one
    row, and two blocks meet in a task, bit by bit; a hash's blocks meet each other once, and give both orders.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_KINDS).cast("int")
    sized = links.select(F.col("a").alias("p"), blocks("na").alias("n")).union(links.select("b", blocks("nb"))).distinct()
    dealt = kinds.join(sized, "p").withColumn("block", F.pmod(F.xxhash64("d", "width", "height"), F.col("n")).cast("int"))

    def pack(rows: pa.Table) -> pa.Table:
        d, w, h = (rows.column(c).to_numpy() for c in ("d", "width", "height"))
        return pa.table({"p": rows.column("p").slice(0, 1), "block": rows.column("block").slice(0, 1), "kinds": pa.array([d.astype("<i8").tobytes() + w.astype("<i4").tobytes() + h.astype("<i4").tobytes()], pa.binary())})

    packed = materialise(dealt.select("p", "block", "d", "width", "height").groupBy("p", "block").applyInArrow(pack, "p long, block int, kinds binary"), "hash-blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    plan = links.select("a", "b", "distance", each("na").alias("i"), "nb").select("a", "b", "distance", "i", each("nb").alias("j")).filter("a <> b or i <= j")
    side = lambda p, block, name: packed.select(F.col("p").alias(p), F.col("block").alias(block), F.col("kinds").alias(name)).hint("merge")
    met = plan.join(side("a", "i", "left"), ["a", "i"]).join(side("b", "j", "right"), ["b", "j"])
    met = met.repartition(2 * kinds.sparkSession.sparkContext.defaultParallelism, "a", "b", "i", "j")

    def unpack(data: pa.Scalar) -> list[np.ndarray]:
        raw = data.as_buffer()
        n = raw.size // 16
        return [np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i4", n, 8 * n), np.frombuffer(raw, "<i4", n, 12 * n)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, distance, i, j = (batch.column(c)[k].as_py() for c in ("a", "b", "distance", "i", "j"))
                left, right = (unpack(batch.column(c)[k]) for c in ("left", "right"))
                x, y = left[0].view(np.uint64), right[0].view(np.uint64)
                for at in range(0, len(x), TILE_KINDS):
                    bits = np.bitwise_count(x[at : at + TILE_KINDS, None] ^ y[None, :])
                    row, col = np.nonzero(bits <= radius)
                    if not len(row):
                        continue
                    dd = bits[row, col].astype(np.int32)
                    sides = [(a, [v[at + row] for v in left]), (b, [v[col] for v in right])]
                    for (p, u), (q, v) in (sides, sides[::-1]) if a == b and i < j else (sides,):
                        n = len(row)
                        yield pa.RecordBatch.from_arrays([pa.array(z) for z in (np.full(n, p), *u, np.full(n, q), *v, np.full(n, distance, np.int32), dd)], _MET)

    parts = met.select("a", "b", "distance", "i", "j", "left", "right").mapInArrow(meet, "lp long, ld long, lw int, lh int, rp long, rd long, rw int, rh int, pd int, dd int")
    kind = lambda s: F.struct(*[F.col(f"{s}{c[0]}").alias(c) for c in ("p", "d", "width", "height")])
    return parts.select(kind("l").alias("lk"), kind("r").alias("rk"), "pd", "dd")


_MET = ["lp", "ld", "lw", "lh", "rp", "rd", "rw", "rh", "pd", "dd"]


def near_pairs(images: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Image pairs of different files and products within the candidate limits, with their distances.

    Pairs of hashes (perceptual, difference) and sizes are found first, each once however many images have them; only
    those within all limits meet their images.
    """
    p, d, a = limits.candidate
    keyed = images.withColumns({"p": long_of_hex("phash"), "d": long_of_hex("dhash")})
    kind = ["p", "d", "width", "height"]
    kinds = materialise(keyed.select(*kind).distinct(), "hash-kinds")
    apart = hamming_pairs(kinds.select(F.col("p").alias("h")), p)
    sizes = kinds.groupBy("p").agg(F.count("*").alias("n"))
    same = sizes.select(F.col("p").alias("a"), F.col("p").alias("b"), F.lit(0).alias("distance"))
    counted = lambda side: sizes.select(F.col("p").alias(side), F.col("n").alias(f"n{side}")).hint("merge")
    links = materialise(apart.unionByName(same).join(counted("a"), "a").join(counted("b"), "b"), "hash-links")
    many = F.col("na") * F.col("nb") > HOT_PAIRS
    l, r = kinds.hint("merge").alias("l"), kinds.hint("merge").alias("r")  # noqa: E741
    delta = aspect_delta(F.col("l.width"), F.col("l.height"), F.col("r.width"), F.col("r.height"))
    met = links.filter(~many).alias("h").join(l, F.expr("h.a = l.p")).join(r, F.expr("h.b = r.p") & (delta <= a) & (hamming("l.d", "r.d") <= d))
    few = met.select(F.struct("l.*").alias("lk"), F.struct("r.*").alias("rk"), F.col("h.distance").alias("pd"), hamming("l.d", "r.d").alias("dd"), delta.alias("ad"))
    delta = aspect_delta(F.col("lk.width"), F.col("lk.height"), F.col("rk.width"), F.col("rk.height"))
    hot = _near_in_blocks(links.filter(many), kinds, d).withColumn("ad", delta).filter(F.col("ad") <= a)
    near = materialise(few.unionByName(hot), "hash-pairs")
    rows = keyed.select(F.struct(*kind).alias("k"), "id", "image_index", "relative_path", "file_sha256")
    wanted = F.expr("h.rk = r.k and l.id <> r.id and l.file_sha256 <> r.file_sha256 and (h.lk.p <> h.rk.p or l.relative_path < r.relative_path)")
    found = near.alias("h").join(rows.alias("l"), F.expr("h.lk = l.k")).join(rows.alias("r"), wanted)
    return found.select(*_oriented("l", "r"), "h.pd", "h.dd", "h.ad")


def _within(limit: tuple[int, int, float]) -> Column:
    return F.expr(f"pd <= {limit[0]} and dd <= {limit[1]} and ad <= {limit[2]}D")


def roll_up(exact: DataFrame, near: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """VISUAL_PAIRS: one row per pair of products.

    Merging is automatic only with an exact trusted pair of first images, or two exact trusted pairs.  The best image pair
    is the least by pHash, dHash and aspect difference, then paths; equal files come first and report distance 0.
    """
    e = exact.select("*", F.lit(-1).alias("pd"), F.lit(-1).alias("dd"), F.lit(0.0).alias("ad"), F.lit(True).alias("equal"))
    n = near.select("*", F.lit(False).alias("trusted"), F.lit(False).alias("equal"))
    rows = e.unionByName(n).groupBy("left_id", "right_id", "left_path", "right_path").agg(
        F.min(F.struct("pd", "dd", "ad")).alias("s"), F.bool_or("trusted").alias("trusted"), F.bool_or("equal").alias("equal"), F.bool_or("primary").alias("primary")
    )  # an image pair once
    rows = rows.select("*", "s.*").withColumns({"strong": ~F.col("equal") & _within(limits.strong), "very": ~F.col("equal") & _within(limits.very_strong)})
    pairs = rows.groupBy("left_id", "right_id").agg(
        F.min(F.struct("pd", "dd", "ad", "left_path", "right_path")).alias("best"),
        F.count_if("trusted").alias("exact_image_pairs"),
        F.count_if("strong").alias("strong_image_pairs"),
        F.count("*").alias("candidate_image_pairs"),
        F.bool_or(F.col("trusted") & F.col("primary")).alias("primary_exact"),
        F.bool_or((F.col("strong") | F.col("very")) & F.col("primary")).alias("primary_near"),
        F.bool_or("equal").alias("any_equal"),
    )
    merge = F.col("primary_exact") | (F.col("exact_image_pairs") >= 2)
    kind = F.when((F.col("exact_image_pairs") > 0) & merge, "exact").when(F.col("exact_image_pairs") > 0, "exact_candidate").when(F.col("any_equal"), "common_image").otherwise("near_candidate")
    return conform(
        pairs.select(
            "*", F.col("best.left_path").alias("left_path"), F.col("best.right_path").alias("right_path"), kind.alias("match_kind"), F.greatest("best.pd", F.lit(0)).alias("phash_distance"),
            F.greatest("best.dd", F.lit(0)).alias("dhash_distance"), F.col("best.ad").alias("aspect_ratio_delta"), (F.col("primary_exact") | F.col("primary_near")).alias("primary_match"), merge.alias("auto_merge"),
        ),
        VISUAL_PAIRS,
    )


def visual_pairs(hashes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """VISUAL_PAIRS of IMAGE_HASHES; rows with errors or without id, index or hashes take no part."""
    images = materialise(hashes.filter("status = 'ok' and id is not null and image_index is not null and phash is not null"), "images")
    exact = exact_pairs(images, limits.most_products)
    return roll_up(exact, near_pairs(images, limits), limits)


KINDS = ("exact", "exact_candidate", "common_image", "near_candidate")


def validate_pairs(pairs: DataFrame, ids: DataFrame) -> None:
    check_schema(pairs, VISUAL_PAIRS, "visual pairs")
    problems = [f"{name}: {n}" for name, n in violations(pairs, {"left id not below right": ~(F.col("left_id") < F.col("right_id")), "unknown kind": ~F.col("match_kind").isin(*KINDS)}).items()]
    if repeated(pairs, ["left_id", "right_id"]):
        problems.append("pairs repeat")
    if not pairs.select(F.col("left_id").alias("id")).union(pairs.select("right_id")).join(ids.select("id"), "id", "left_anti").isEmpty():
        problems.append("unknown ids")
    demand(problems, "visual pairs")


def validate_hashes(hashes: DataFrame, images: DataFrame) -> None:
    check_schema(hashes, IMAGE_HASHES, "image hashes")
    whole = [c for c in ("file_sha256", "phash", "dhash", "width", "height")]
    problems = [f"{name}: {n}" for name, n in violations(hashes, {"incomplete": (F.col("status") == "ok") & F.expr(" or ".join(f"{c} is null" for c in whole))}).items()]
    wanted = images.filter("in_dataset and status = 'ok' and id is not null and image_index is not null").select("relative_path")
    if repeated(hashes, ["relative_path"]) or not wanted.exceptAll(hashes.select("relative_path")).isEmpty() or not hashes.select("relative_path").exceptAll(wanted).isEmpty():
        problems.append("paths are not those of the eligible images")
    demand(problems, "image hashes")
