"""Uniform shuffle into shards of exact size through a communication matrix.

How many rows of each partition go to each shard follows the law these counts have under a uniform random permutation: a
multivariate hypergeometric one.  It is drawn along a tree: the counts of a range of partitions are divided between its
halves, each range with a generator of its own, so a task works out its line of the matrix by one draw for each level,
and all tasks agree.  Each partition then permutes its multiset of shard labels over its rows (drawn batch by batch,
without replacement), rows are exchanged by shard and block, and each block is permuted again by a random key.  Blocks
keep a task's share bounded however large a shard is.  The driver and each task hold one number for each partition.

Law `rows`: shard counts differ by one at most, lower shards first.  Groups of equal texts are not kept together: under
a uniform shuffle each row is placed by itself.  Defined cases: null texts have size 8 and the checksum of no bytes;
null or repeated ids are rows like any others; an empty table gives an empty result; with fewer rows than shards the
rest stay empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from .store import materialise

#: Rows of a shard that one task permutes.
BLOCK_ROWS = 16_384


#: numpy draws from populations below this alone.
_MOST = 10**9


def hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` draws without replacement are good, in populations of any size.

    Large ones: the chances around the mode by their ratios, over twelve deviations either way, beyond which less than
    1e-30 is left.
    """
    if good + bad < _MOST:
        return int(draw.hypergeometric(good, bad, sample))
    total = good + bad
    least, most = max(0, sample - bad), min(good, sample)
    deviation = np.sqrt(sample * (good / total) * (bad / total) * ((total - sample) / max(total - 1, 1)))
    mode = (sample + 1) * (good + 1) // (total + 2)
    lo, hi = max(least, mode - int(12 * deviation) - 30), min(most, mode + int(12 * deviation) + 30)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log((good - k) * (sample - k)) - np.log((k + 1) * (bad - sample + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(chance, draw.random() * chance[-1], side="right"))


def divided(draw: np.random.Generator, lack: np.ndarray, sample: int) -> np.ndarray:
    """How many of each kind are among `sample` draws without replacement from lack."""
    out, rest = np.zeros_like(lack), int(lack.sum())
    for i, n in enumerate(lack.tolist()):
        if sample:
            rest -= n
            out[i] = hypergeometric(draw, n, rest, sample)
            sample -= int(out[i])
    return out


def share_of(ends: np.ndarray, p: int, shards: int, seed: int) -> np.ndarray:
    """Line p of the matrix: rows that partition p sends to each shard.  ends: 0, then the running number of rows."""
    lo, hi, total = 0, len(ends) - 1, int(ends[-1])
    lack = np.full(shards, total // shards, np.int64)
    lack[: total % shards] += 1
    while hi - lo > 1:
        middle = (lo + hi) // 2
        left = divided(np.random.Generator(np.random.PCG64([seed, 0, lo, hi])), lack, int(ends[middle] - ends[lo]))
        lack, lo, hi = (left, lo, middle) if p < middle else (lack - left, middle, hi)
    return lack


def local_labels(ends: Broadcast, place: Broadcast, shards: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        at = int(np.searchsorted(place.value, p))
        there = at < len(place.value) and place.value[at] == p
        left = share_of(ends.value, at, shards, seed) if there else np.zeros(1, np.int64)
        draw = np.random.Generator(np.random.PCG64([seed, 1, p]))
        for batch in batches:
            n = batch.num_rows
            if n > left.sum():
                raise RuntimeError(f"partition {p} has more rows than were counted: its input is not read the same way twice")
            take = divided(draw, left, n)
            left = left - take
            shard = draw.permutation(np.repeat(np.arange(len(take), dtype=np.int32), take))
            key = draw.integers(0, 2**62, n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32()), pa.array(key, pa.int64())], [*batch.schema.names, "shard", "_key"])
        if left.sum():
            raise RuntimeError(f"partition {p} has fewer rows than were counted: its input is not read the same way twice")

    return run


def shard_rows(rows: DataFrame, shards: int = 24, seed: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with shard int and slot long (gapless from 0 in each shard), uniformly at random for each seed.

    rows must come from a scan or written table, so that it is read in the same partitions twice; else this raises.
    """
    counted = {r["p"]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    order = sorted(counted)
    context = rows.sparkSession.sparkContext
    ends = context.broadcast(np.concatenate([[0], np.cumsum([counted[p] for p in order], dtype=np.int64)]).astype(np.int64))  # 8 bytes for each partition
    place = context.broadcast(np.array(order, np.int64))
    names = rows.columns
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + ["shard int", "_key long"])
    labelled = materialise(rows.mapInArrow(local_labels(ends, place, shards, seed), schema), "sharded")
    blocks = max(1, -(-sum(counted.values()) // (shards * block_rows)))
    labelled = labelled.withColumn("_block", F.expr(f"_key div {-(-(2**62) // blocks)}"))
    starts = labelled.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("_key", *[F.col(f"`{n}`") for n in names[:1]])
    placed = labelled.withColumn("_rank", F.row_number().over(inside) - 1)
    return placed.join(starts, ["shard", "_block"]).select(*[F.col(f"`{n}`") for n in names], "shard", (F.col("_start") + F.col("_rank")).alias("slot"))
