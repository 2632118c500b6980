import itertools
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from shelfmark.contracts import IMAGE_HASHES
from shelfmark.operators import retrieval, visual


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_hashes_do_not_go_through_the_driver(spark):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"))
    assert "Broadcast" not in plan(visual.hamming_pairs(hashes))


def test_a_hash_of_very_many_kinds_is_compared_in_blocks(spark, monkeypatch):
    r = random.Random(8)
    near = [r.getrandbits(60) for _ in range(6)]
    rows = []
    for i in range(160):
        p = (0, 0, 0b111, r.getrandbits(60))[i % 4]
        d = near[i % 6] ^ sum(1 << b for b in r.sample(range(60), r.randrange(0, 8)))
        rows.append((i // 2, i % 2, f"{i:03d}", f"sha{i % 150}", f"{p:016x}", f"{d:016x}", 100 + i % 5 * 2, 100, "ok", None))
    images = spark.createDataFrame(rows, IMAGE_HASHES)
    want = set()
    for x, y in itertools.combinations(rows, 2):
        pd, dd = ((int(x[k], 16) ^ int(y[k], 16)).bit_count() for k in (4, 5))
        ratio = sorted((x[6] / x[7], y[6] / y[7]))
        if x[0] != y[0] and x[3] != y[3] and pd <= 6 and dd <= 10 and (ratio[1] - ratio[0]) / ratio[1] <= 0.05:
            want.add((*((x[2], y[2]) if x[0] < y[0] else (y[2], x[2])), pd, dd))
    for hot, kinds, tile in ((1 << 12, 1 << 15, 16), (0, 1 << 15, 16), (8, 7, 3)):
        monkeypatch.setattr(visual, "HOT_PAIRS", hot)
        monkeypatch.setattr(visual, "BLOCK_KINDS", kinds)
        monkeypatch.setattr(visual, "TILE_KINDS", tile)
        got = [(r.left_path, r.right_path, r.pd, r.dd) for r in visual.near_pairs(images).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_neighbours_hold_a_tile_of_distances(spark, monkeypatch):
    """Many blocks, tiles and ties; the distances of a query batch to all vectors are never held at once."""
    r = np.random.default_rng(4)
    x = r.normal(size=(230, 6)).round(1)
    x[100:160] = x[:60]  # equal vectors: ties by id
    x[7] = 0
    rows = [(i * 3, i % 4 if i < 200 else 9, x[i].tolist()) for i in range(len(x))]
    v = spark.createDataFrame(rows, "id long, fold int, vector array<float>")
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 3000)
    monkeypatch.setattr(retrieval, "TILE", (8, 11))
    got = {}
    for n in retrieval.fold_safe_neighbors(v, 5).collect():
        got.setdefault(n.id, {})[n.rank] = (n.distance, n.neighbor)
    u = retrieval._unit(x.astype(np.float32).astype(float))
    for i, (key, fold, _) in enumerate(rows):
        far = sorted((round(1 - float(u[i] @ u[j]), 9), other) for j, (other, theirs, _) in enumerate(rows) if theirs != fold)[:5]
        assert [got[key][rank] for rank in range(1, 6)] == far
    folds, ids = np.zeros(20_000, np.int64), np.arange(20_000)
    u = retrieval._unit(r.normal(size=(20_000, 8)))
    monkeypatch.undo()
    tracemalloc.start()
    retrieval._best(ids[:512], folds[:512], u[:512], ids, folds + 1, u, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
