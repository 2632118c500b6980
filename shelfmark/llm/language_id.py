"""Language identification with error-correcting output codes.

Each language has a codeword of bits.  One linear n-gram classifier per bit tells the languages whose bit is 1 from the
others; its weights are log ratios of smoothed n-gram shares, averaged over languages so that a frequent language does
not dominate.  A text's margins are weighted means over its n-grams, and the codeword with the least total logistic
loss, each bit weighted by how far its two sides' n-gram distributions lie apart, is the prediction.

n-grams are pairs and triples of bytes of the lower-cased text, hashed to fixed tables; ASCII other than letters counts
as one blank, and n-grams of two blanks are left out.

Defined cases: a null text, or one without any letter, is `und` with score 0; rows with null lang or text, or whose id
is held out, are not learned from; with a single language all texts with letters get it with score 1, and with none
they are `und`; ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .buffers import lean, raw, slices

PAIRS, TRIPLES = 1 << 12, 1 << 13
FEATURES = PAIRS + TRIPLES
#: At most about so many labelled rows are learned from, chosen by a hash of their id.
TRAIN_ROWS = 20_000
SMOOTH = 0.5
#: Bits of codewords are all splits for up to 7 languages, else so many times log2 of their number.
BITS_PER_LOG2 = 10
SHARPNESS = 3.0
AMBIGUOUS = 0.15
UNKNOWN = "und"
PREDICTED = "lang_pred string, score double, runner_up string, ambiguous boolean"

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[[c for c in range(128) if not chr(c).isalpha()]] = 32


def gram_counts(text: pa.Array) -> np.ndarray:
    """Rows by FEATURES: how often each n-gram is in each text."""
    data, offsets = raw(pc.utf8_lower(pc.fill_null(text, "")))
    n, rows = len(data), len(offsets) - 1
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets)) * FEATURES
    c = _CLASS[data]
    pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    out = np.zeros(rows * FEATURES, np.int64)
    if n >= 2:
        keep = (row[:-1] == row[1:]) & ((c[:-1] != 32) | (c[1:] != 32))
        at = row[:-1] + ((pair ^ (pair >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> np.uint32(20))
        out += np.bincount(at[keep], minlength=len(out))
        if n >= 3:
            keep = keep[:-1] & keep[1:]
            triple = pair[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
            at = row[:-2] + ((triple ^ (triple >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> np.uint32(19)) + PAIRS
            out += np.bincount(at[keep], minlength=len(out))
    return out.reshape(rows, FEATURES)


def in_groups(batch: pa.RecordBatch, column: str, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, column):
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of bits in -1, +1: every split of up to 7 languages; beyond, the best of some random codes by least distance."""
    if k <= 7:
        return np.array([[1 if i == 0 or (split >> (i - 1)) & 1 else -1 for split in range(2 ** (k - 1) - 1)] for i in range(k)], np.int8).reshape(k, -1)
    bits, draw = int(BITS_PER_LOG2 * np.ceil(np.log2(k))), np.random.default_rng(seed)
    tries = [draw.choice(np.array([-1, 1], np.int8), (k, bits)) for _ in range(50)]
    return max(tries, key=lambda c: ((bits - c.astype(int) @ c.T.astype(int)) // 2 + bits * np.eye(k, dtype=int)).min())


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages by bits
    weights: np.ndarray  # FEATURES by bits
    trust: np.ndarray  # by bit

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best, its score, second best, ambiguous) of each row."""
        rows = len(counts)
        if len(self.langs) < 2:
            return np.zeros(rows, int), np.ones(rows), np.zeros(rows, int), np.zeros(rows, bool)
        margins = (counts @ self.weights) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        z = SHARPNESS * margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -z) * self.trust).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        order = np.argsort(loss, axis=1, kind="stable")[:, :2]
        top = np.take_along_axis(share, order, 1)
        return order[:, 0], top[:, 0], order[:, 1], top[:, 0] - top[:, 1] < AMBIGUOUS


def model_of(counts: dict[str, np.ndarray]) -> Model:
    """The bit classifiers from each language's n-gram counts."""
    langs = sorted(counts)
    code = codewords(len(langs)) if langs else np.zeros((0, 0), np.int8)
    if len(langs) < 2:
        return Model(langs, code, np.zeros((FEATURES, code.shape[1])), np.ones(code.shape[1]))
    share = np.array([counts[x] + SMOOTH for x in langs], float)
    for part in (slice(0, PAIRS), slice(PAIRS, FEATURES)):
        share[:, part] /= share[:, part].sum(axis=1, keepdims=True)
    one = np.stack([share[code[:, b] > 0].mean(axis=0) for b in range(code.shape[1])])
    zero = np.stack([share[code[:, b] < 0].mean(axis=0) for b in range(code.shape[1])])
    middle = (one + zero) / 2
    apart = (one * np.log(one / middle) + zero * np.log(zero / middle)).sum(axis=1)
    return Model(langs, code, np.log(one / zero).T.copy(), apart / apart.mean())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows in in_groups(batch, "text"):
            lang = np.array(rows.column("lang").to_pylist(), object)
            counts = gram_counts(rows.column("text"))
            for x in set(lang):
                total[x] = total.get(x, 0) + counts[lang == x].sum(axis=0)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "counts": pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())})


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, tasks: int = 12) -> Model:
    """From rows with text and lang that are not held out: at most about train_rows of them, by a hash of the id."""
    rows = docs.filter(~F.coalesce(held_out(), F.lit(True)) & F.col("lang").isNotNull())
    there = rows.count()
    if there > train_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * train_rows / there))
    parts = rows.filter(F.col("text").isNotNull()).select("doc_id", "lang", "text").repartition(tasks, "doc_id").select("lang", "text")
    total: dict[str, np.ndarray] = {}
    for row in parts.mapInArrow(lean(_count), "lang string, counts binary").toLocalIterator():  # one row for each task and language
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["counts"], "<i8")
    return model_of(total)


def predictor(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            for rows in in_groups(batch, "text"):
                text = rows.column("text")
                best, score, second, unsure = model.predict(gram_counts(text))
                known = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)) & bool(model.langs)
                best, second = np.where(known, best, len(model.langs)), np.where(known, second, len(model.langs))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(names[best], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(names[second], pa.string()), pa.array(unsure & known)],
                    [*rows.schema.names, "lang_pred", "score", "runner_up", "ambiguous"],
                )

    return run


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """All columns of docs, then PREDICTED (columns of docs with these names are replaced)."""
    new = [x.split()[0] for x in PREDICTED.split(", ")]
    docs = docs.drop(*new)
    rows = docs if text_column == "text" else docs.withColumn("text", F.col(text_column))
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + [PREDICTED])
    out = rows.mapInArrow(lean(predictor(model)), schema)
    return out.select(*[F.col(f"`{n}`") for n in docs.columns], *new)
