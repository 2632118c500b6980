"""Nearest neighbours of other folds, and what their labels say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.sources.scratch import materialise

#: Bytes of packed vectors that a task reads beside its queries at most.
MOST_BROADCAST = 64 << 20
BLOCK_ROWS = 4096
#: Queries and others whose distances a task holds at once.
TILE = (256, 4096)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


Best = tuple[np.ndarray, np.ndarray]


def _none(n: int, k: int) -> Best:
    return np.full((n, k), np.inf), np.zeros((n, k), np.int64)


def _meet(folds: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other_folds: np.ndarray, y: np.ndarray, best: Best) -> None:
    """Brings best (distances, ids) of the queries up to date with the others: cosine, ties by id, none of the own fold.

    Only those that come within the k-th distance so far are rounded and sorted; tiles are of a fixed size.
    """
    k = best[0].shape[1]
    for at in range(0, len(x), TILE[0]):
        far, near = (v[at : at + TILE[0]] for v in best)
        own = folds[at : at + TILE[0]]
        for start in range(0, len(y), TILE[1]):
            ids, theirs = other_ids[start : start + TILE[1]], other_folds[start : start + TILE[1]]
            alike = x[at : at + TILE[0]] @ y[start : start + TILE[1]].T
            least = 1 - far[:, -1] - 1e-9
            if np.isinf(least).any() and len(ids) > k:
                open_ = np.flatnonzero(np.isinf(least))
                other = np.where(own[open_, None] == theirs[None, :], -np.inf, alike[open_])
                least[open_] = np.partition(other, -k, axis=1)[:, -k] - 1e-9
            row, col = np.nonzero(alike >= least[:, None])
            fits = own[row] != theirs[col]
            row, col = row[fits], col[fits]
            if not len(row):
                continue
            touched = np.unique(row)
            rows = np.concatenate([np.repeat(touched, k), row])
            dist = np.concatenate([far[touched].ravel(), np.round(1 - alike[row, col], 9)])
            them = np.concatenate([near[touched].ravel(), ids[col]])
            order = np.lexsort((them, dist, rows))
            first = np.searchsorted(rows[order], touched)
            kept = order[first[:, None] + np.arange(k)]
            far[touched], near[touched] = dist[kept], them[kept]


def _found(ids: np.ndarray, best: Best) -> dict[str, np.ndarray]:
    row, col = np.nonzero(np.isfinite(best[0]))
    return {"id": ids[row], "neighbor": best[1][row, col], "distance": best[0][row, col]}


def _best(ids: np.ndarray, folds: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other_folds: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of the others by cosine distance, ties by id, none of the own fold."""
    best = _none(len(ids), k)
    _meet(folds, x, other_ids, other_folds, y, best)
    return pd.DataFrame(_found(ids, best))


def fold_safe_neighbors(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(id, rank, neighbor, distance) of vectors (id, fold, vector): exact, cosine, only neighbours of other folds.

    Vectors are packed into blocks of 2 * BLOCK_ROWS, one row each.  A task takes some blocks as queries and lets others of
    up to MOST_BROADCAST bytes pass by one after the other, keeping each query's k best: it holds two blocks and a tile of
    distances, whatever the number of vectors, and only each task's best are shuffled.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    n, width = size.n, max(size.d or 0, 1)
    blocks = max(1, -(-n // (2 * BLOCK_ROWS)))

    def pack(rows: pa.Table) -> pa.Table:
        x = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, width)
        parts = [rows.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "fold")]
        return pa.table({"block": rows.column("block").slice(0, 1), "data": pa.array([b"".join([*parts, _unit(x).astype("<f8").tobytes()])], pa.binary())})

    def unpack(data: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = data.as_buffer()
        m = raw.size // (8 * (width + 2))
        return np.frombuffer(raw, "<i8", m), np.frombuffer(raw, "<i8", m, 8 * m), np.frombuffer(raw, "<f8", m * width, 16 * m).reshape(m, width)

    dealt = vectors.select("id", "fold", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    packed = materialise(dealt.groupBy("block").applyInArrow(pack, "block int, data binary"), "vectors")
    parts = min(blocks, -(-n * width * 8 // max(MOST_BROADCAST, 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, best = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if (block := batch.column("block")[i].as_py()) != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict(_found(own[0], best))
                    now, own = block, [v.copy() for v in unpack(batch.column("data")[i])]
                    best = _none(len(own[0]), k)
                _meet(own[1], own[2], *unpack(batch.column("others")[i]), best)
        if now is not None:
            yield pa.RecordBatch.from_pydict(_found(own[0], best))

    queries = packed.repartition(min(blocks, 2 * spark.sparkContext.defaultParallelism), "block")
    others = packed.select(F.col("data").alias("others")).repartition(max(1, parts)).hint("shuffle_replicate_nl")  # blocks by blocks
    found = queries.crossJoin(others).mapInArrow(search, "id long, neighbor long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "neighbor", "distance")


#: Vectors that lists are learned from at most, chosen by a hash of their id; a list is meant to hold so many vectors of a sample.
SAMPLE_ROWS, SAMPLE_LIST = 16_384, 64


def list_centres(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> np.ndarray:
    """Unit centres of lists, by k-means over a bounded sample; at most sample_rows / SAMPLE_LIST of them."""
    n = vectors.count()
    own = vectors.select("id", "vector")
    if n > sample_rows:
        own = own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 24)) < int((1 << 24) * sample_rows / n))
    found = own.orderBy(F.xxhash64("id"), "id").toPandas()["vector"].tolist()
    if not found:
        return np.zeros((0, 1))
    x = _unit(np.array(found, float))
    centres = x[: max(1, len(x) // SAMPLE_LIST)].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def indexed_neighbors(vectors: DataFrame, k: int = 10, probes: int = 8, queries: DataFrame | None = None) -> DataFrame:
    """fold_safe_neighbors by an inverted file: (id, rank, neighbor, distance), exact within the lists that are looked at.

    Every vector is in the list of its nearest centre; a query looks at the `probes` lists nearest to it.  Long lists, and
    the queries that ask for them, are dealt into blocks, so no task holds more than two blocks.  queries (id, fold,
    vector) are all vectors unless given.  More probes find more of the true neighbours; with all lists it is exact.
    """
    centres = list_centres(vectors)
    schema = "id long, neighbor long, distance double"
    width = centres.shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast(centres)  # SAMPLE_ROWS / SAMPLE_LIST vectors at most
    unpack = lambda df: (df["id"].to_numpy(), df["fold"].to_numpy(), _unit(np.array(df["vector"].tolist(), float).reshape(len(df), width)))

    def placed(rows: DataFrame, many: int) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                near = unpack(part)[2] @ sent.value.T
                yield part.assign(lists=list(np.argsort(-near, axis=1, kind="stable")[:, :many].astype(np.int32)))

        found = rows.select("id", "fold", "vector").mapInPandas(run, ", ".join([*(f"{n} {t}" for n, t in rows.select("id", "fold", "vector").dtypes), "lists array<int>"]))
        return found.select("id", "fold", "vector", F.explode("lists").alias("list"))

    held = placed(vectors, 1)
    asked = placed(vectors if queries is None else queries, max(1, min(probes, len(centres))))
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
    plan = blocks(held, "held").join(blocks(asked, "asked"), "list")  # a line for each list
    part = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    a = asked.join(F.broadcast(plan), "list").select("list", part("asked").alias("q"), each("held").alias("h"), "id", "fold", "vector")
    b = held.join(F.broadcast(plan), "list").select("list", each("asked").alias("q"), part("held").alias("h"), "id", "fold", "vector")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _best(*unpack(x), *unpack(y), k) if len(x) and len(y) else pd.DataFrame({"id": [], "neighbor": [], "distance": []})

    found = a.groupBy("list", "q", "h").cogroup(b.groupBy("list", "q", "h")).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "neighbor", "distance")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors of one length; null if either is null, 0 if either has no length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).when(size == 0, F.lit(0.0))


def text_image_similarity(embeddings: DataFrame, text: str = "text", image: str = "image") -> DataFrame:
    """(id, text_image_similarity, best_image_similarity, image_disagreement) of vectors (id, kind, vector).

    The mean and the largest cosine between a product's text and its images, and how far apart the least and the largest
    lie.  Products without a text vector or without images have no row.
    """
    texts = embeddings.filter(F.col("kind") == text).select("id", F.col("vector").alias("text"))
    pairs = embeddings.filter(F.col("kind") == image).join(texts, "id").select("id", cosine("text", "vector").alias("c"))
    return pairs.groupBy("id").agg(F.avg("c").alias("text_image_similarity"), F.max("c").alias("best_image_similarity"), (F.max("c") - F.min("c")).alias("image_disagreement"))


def neighbor_features(neighbors: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """One row per id: share of positive neighbours among the first k, distances to the nearest of each label, their
    difference (negative minus positive), and the distance to the nearest of all.  Null where there is none."""
    rows = neighbors.join(labels.select(F.col("id").alias("neighbor"), "label"), "neighbor")
    shares = [F.avg(F.when(F.col("rank") <= k, F.col("label"))).alias(f"positive_share_{k}") for k in ks]
    near = rows.groupBy("id").agg(*shares, F.min(F.when(F.col("label") == 1, F.col("distance"))).alias("nearest_positive_distance"), F.min(F.when(F.col("label") == 0, F.col("distance"))).alias("nearest_negative_distance"), F.min("distance").alias("ood_distance"))
    return near.withColumn("neighbor_margin", F.col("nearest_negative_distance") - F.col("nearest_positive_distance"))


def hard_examples(oof: DataFrame, neighbors: DataFrame, labels: DataFrame, confident: float = 0.9, near: float = 0.1) -> DataFrame:
    """(id, reason): confident_wrong, conflict, disagreement, or near_opposite (a neighbour of the other label within near)."""
    p = F.col("text_logreg_probability")
    wrong = ((p >= confident) & (F.col("true_label") == 0)) | ((p <= 1 - confident) & (F.col("true_label") == 1))
    reasons = F.array_compact(F.array(F.when(wrong, "confident_wrong"), F.when(F.col("text_rule_conflict") == 1, "conflict"), F.when(F.col("text_models_disagree") == 1, "disagreement")))
    own = oof.select("id", F.explode(reasons).alias("reason"))
    sides = neighbors.filter(F.col("distance") <= near).join(labels.select("id", "label"), "id").join(labels.select(F.col("id").alias("neighbor"), F.col("label").alias("other")), "neighbor")
    return own.union(sides.filter("label <> other").select("id", F.lit("near_opposite"))).distinct()
