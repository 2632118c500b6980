"""Order-preserving packing by dynamic programming over document and sentence boundaries.

Each partition's documents form one token stream in row order.  Window cuts are chosen among document ends (free),
sentence ends (a small penalty) and, inside sentences longer than GRID, every GRID-th id (a truncation penalty), so that
padding plus penalties is least.  With f the cost up to a boundary, f[j] = penalty[j] + width - b[j] + min(f[i] + b[i])
over i with b[j] - b[i] <= width; a monotone queue finds each minimum in constant time.  The stream is solved in blocks;
the last window of a block is left open and solved again with the next one, so memory is bounded by a block or the
longest document.

Defined cases: a null or empty text is its closing id alone; null or repeated ids are documents like any others; an
empty table gives no pieces; further columns are ignored.  Sequence ids are partition * 2**32 + place in it.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .buffers import lean, slices
from .vocabulary import encoder

WIDTH = 4096
END_ID = 2
SENTENCE, TRUNCATION, GRID = 4, 48, 64
#: Bytes of text that are encoded together: the larger, the fewer distinct chunks to look up for each word, and the larger the temporaries.
SLICE = 1 << 20
#: Tokens of a block.
BLOCK = 1 << 19
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(places: np.ndarray, penalties: np.ndarray, width: int = WIDTH) -> list[int]:
    """Indexes of the chosen boundaries, first and last included.

    places ascend from 0 and no two neighbours are more than width apart; a cut at i costs penalties[i], a window its padding.
    """
    at, pen = places.tolist(), penalties.tolist()
    best = [0] * len(at)  # f[i] + b[i]
    came = [0] * len(at)
    queue = deque([0])
    for j in range(1, len(at)):
        b = at[j]
        while b - at[queue[0]] > width:
            queue.popleft()
        i = queue[0]
        came[j] = i
        f = pen[j] + width + best[i]  # f[j] + b[j]
        best[j] = f
        while queue and best[queue[-1]] >= f:
            queue.pop()
        queue.append(j)
    out = [len(at) - 1]
    while out[-1]:
        out.append(came[out[-1]])
    return out[::-1]


def boundaries(sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of all boundaries after position 0 of a stream of documents with these sizes and sentence ends."""
    docs = np.cumsum(sizes)
    soft = np.union1d(ends, docs)
    before = np.concatenate([[0], soft[:-1]])
    inner = (soft - before - 1) // GRID
    forced = np.repeat(before - np.concatenate([[0], np.cumsum(inner)[:-1]]) * GRID, inner) + (np.arange(int(inner.sum())) + 1) * GRID
    places = np.concatenate([soft, forced])
    penalties = np.concatenate([np.full(len(soft), SENTENCE), np.full(len(forced), TRUNCATION)])
    penalties[np.searchsorted(soft, docs)] = 0
    order = np.argsort(places, kind="stable")
    return places[order].astype(np.int64), penalties[order].astype(np.int64)


class Stream:
    """One partition's open tokens, and the pieces of the windows that are closed."""

    def __init__(self, first_sequence: int, width: int = WIDTH):
        self.sequence, self.width = first_sequence, width
        self.ids, self.docs = [], []  # arrays of ids; (doc_id, size, ids of it already in closed windows)
        self.places, self.penalties, self.size = [], [], 0

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> None:
        places, penalties = boundaries(sizes, ends)
        self.places.append(places + self.size)
        self.penalties.append(penalties)
        self.ids.append(ids)
        self.docs += [(d, n, 0) for d, n in zip(doc_ids, sizes.tolist(), strict=True)]
        self.size += len(ids)

    def close(self, last: bool) -> pa.RecordBatch | None:
        """Cut what is held; unless last, the final window stays open."""
        if not self.size:
            return None
        places = np.concatenate([[0], *self.places])
        penalties = np.concatenate([[0], *self.penalties])
        chosen = best_cuts(places, penalties, self.width)
        if not last and len(chosen) > 1:
            chosen = chosen[:-1]
        cuts = places[chosen]
        if len(cuts) < 2:
            return None
        ids = np.concatenate(self.ids)
        left = np.array([n - done for _, n, done in self.docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(left)[:-1]])
        stop = int(cuts[-1])
        begins = np.union1d(starts[starts < stop], cuts[:-1])
        of = np.searchsorted(starts, begins, side="right") - 1
        window = np.searchsorted(cuts, begins, side="right") - 1
        finish = np.append(begins[1:], stop)
        done = np.array([d for _, _, d in self.docs], np.int64)
        data = ids.astype("<u4").tobytes()
        out = pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([self.docs[i][0] for i in of.tolist()], pa.int64()),
                "start": begins - starts[of] + done[of],
                "length": finish - begins,
                "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), finish.tolist(), strict=True)], pa.int64()),
                "doc_tokens": np.array([n for _, n, _ in self.docs], np.int64)[of],
                "sequence_id": self.sequence + window,
                "offset": begins - cuts[window],
            }
        )
        self.sequence += len(cuts) - 1
        whole = int(np.searchsorted(starts + left, stop, side="right"))
        self.docs = self.docs[whole:]
        if self.docs and starts[whole] < stop:
            d, n, before = self.docs[0]
            self.docs[0] = d, n, before + int(stop - starts[whole])
        self.ids, self.size = [ids[stop:]], len(ids) - stop
        keep = places > stop
        self.places, self.penalties = [places[keep] - stop], [penalties[keep]]
        return out


def with_end(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, ends_per_row: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Append end_id to every row's ids; sentence ends move along."""
    rows = np.arange(len(sizes))
    out = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)) if len(sizes) else ids
    return out, sizes + 1, ends + np.repeat(rows, ends_per_row)


def pack_partition(path: str, width: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(TaskContext.get().partitionId() << 32, width)
        with encoder(path) as own:
            for batch in batches:
                for rows in slices(batch, "text", SLICE):
                    ids, sizes, ends, per_row = own.encode(rows.column("text"))
                    ids, sizes, ends = with_end(ids, sizes, ends, per_row, END_ID)
                    stream.add(rows.column("doc_id").to_pylist(), ids, sizes, ends)
                    if stream.size >= block and (out := stream.close(last=False)) is not None:
                        yield out
        if (out := stream.close(last=True)) is not None:
            yield out

    return run


def pack(docs: DataFrame, tokenizer_path: str, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """PIECES of docs (doc_id long, text string).  No shuffle: each partition fills its own sequences."""
    return docs.select("doc_id", "text").mapInArrow(lean(pack_partition(tokenizer_path, width, block)), PIECES)
