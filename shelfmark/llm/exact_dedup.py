"""Exact deduplication against a minimal perfect hash of the digests already held.

The history is reduced to its distinct SHA-256 digests.  Each bucket of digests gets a minimal perfect hash whose slots
hold the full digest, the winner's id and the number of copies; a lookup counts only if all 32 bytes agree.  Incoming
digests that are members join the slot's group; nonmembers form groups of their own.

Defined cases: a null text equals an empty one; a null id never wins unless its whole group has none; rows that repeat
an id and a text get the same answer each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .buffers import mix, raw
from .store import materialise

#: Distinct digests a bucket is meant to hold: about 6 MB.
BUCKET_ROWS = 65_536
NO_ID = -(2**63)
GROUPS = "digest binary, keep_id long, group_size long, member boolean"


class PerfectHash:
    """Maps n distinct digests to 0..n-1 in levels: a key stays at the first level where no other key shares its place."""

    def __init__(self, digests: np.ndarray, spread: float = 2.0, most_levels: int = 40):
        self.n = len(digests)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(self.n), 0
        slot = np.empty(self.n, np.int64)
        keys = self.words(digests)
        while len(left) and len(self.levels) < most_levels:
            size = max(1, int(spread * len(left)))
            at = self.place(keys[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            won = alone[at]
            slot[left[won]] = rank[at[won]]
            base += int(won.sum())
            self.levels.append((alone, rank))
            left = left[~won]
        #: Keys whose first 16 bytes agree with another's can never be told apart above.
        self.rest = {digests[i].tobytes(): base + j for j, i in enumerate(left)}
        slot[left] = base + np.arange(len(left))
        self.slot_of_input = slot

    @staticmethod
    def words(digests: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(digests[:, :16]).view(np.uint64).reshape(-1, 2)

    @staticmethod
    def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix(words[:, 0] ^ mix(words[:, 1] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))))
        return (h % np.uint64(size)).astype(np.int64)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """A slot for each digest; -1 if no level claims it. A digest that was not put in may get any slot."""
        out = np.full(len(digests), -1, np.int64)
        left, words = np.arange(len(digests)), self.words(digests)
        for level, (alone, rank) in enumerate(self.levels):
            if not len(left):
                return out
            at = self.place(words[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        for i in left:
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        return out


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not table.num_rows:
        return np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, _ = raw(table.column("digest"))
    return data.reshape(-1, 32), table.column("best").to_numpy(), table.column("copies").to_numpy()


def resolve(history: pa.Table, incoming: pa.Table) -> pa.Table:
    """One bucket: groups of all its digests."""
    held, best, copies = _columns(history)
    asked, new_best, new_copies = _columns(incoming)
    index = PerfectHash(held)
    slots, winner, count = np.empty_like(held), np.empty_like(best), np.empty_like(copies)
    slots[index.slot_of_input], winner[index.slot_of_input], count[index.slot_of_input] = held, best, copies
    at = index.lookup(asked)
    member = at >= 0
    member[member] = (slots[at[member]] == asked[member]).all(axis=1)
    np.maximum.at(winner, at[member], new_best[member])
    np.add.at(count, at[member], new_copies[member])
    alone = ~member
    digests = np.concatenate([slots, asked[alone]])
    return pa.table(
        {
            "digest": pa.array([x.tobytes() for x in digests], pa.binary()),
            "keep_id": pa.array(np.concatenate([winner, new_best[alone]]), pa.int64()),
            "group_size": pa.array(np.concatenate([count, new_copies[alone]]), pa.int64()),
            "member": pa.array(np.arange(len(digests)) < len(slots), pa.bool_()),
        }
    )


def default_history(id_column: str) -> Column:
    """With no history given, about half of the rows play its part, chosen by id alone."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 2 == 0


def digest_groups(keys: DataFrame, buckets: int) -> DataFrame:
    """keys: id long, digest binary, held boolean.  One row per distinct digest: GROUPS."""
    one_side = lambda held: (
        keys.filter(F.col("held") == held)
        .select(F.col("id").alias("id"), F.col("digest").alias("digest"))  # new attributes: a cogroup of one table with itself needs them
        .groupBy("digest")
        .agg(F.coalesce(F.max("id"), F.lit(NO_ID)).alias("best"), F.count("*").alias("copies"))
        .withColumn("bucket", F.crc32("digest") % buckets)
    )
    return one_side(True).groupBy("bucket").cogroup(one_side(False).groupBy("bucket")).applyInArrow(resolve, GROUPS)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", history: Column | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of docs: id, keep_id (largest id of its copies), group_size, kept, text_sha256."""
    held = default_history(id_column) if history is None else F.coalesce(history, F.lit(False))
    keys = materialise(
        docs.select(F.col(id_column).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")).cast("binary"), 256)).alias("digest"), held.alias("held")),
        "exact-keys",
    )
    groups = digest_groups(keys, max(1, -(-keys.count() // bucket_rows)))
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return keys.join(groups, "digest").select(
        F.col("id").alias(id_column), keep.alias("keep_id"), "group_size", F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )

