"""Arrow string columns as numpy buffers, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; its temporaries are a few dozen times as large.
SLICE_BYTES = 1 << 20


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; row i is bytes[offsets[i]:offsets[i + 1]], and a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if column.null_count:  # a null row may own bytes in the buffer
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        if sizes.sum() != len(data):
            data = np.concatenate([data[offsets[i] : offsets[i] + sizes[i]] for i in range(n)])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return data, offsets


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of batch in order, cut so that each slice has at most `most` bytes in column, or one row."""
    if batch.num_rows == 0:
        return
    _, offsets = raw(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(batch.num_rows, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def give_back() -> None:
    """Return what this worker has freed to the machine: allocators keep it, and the worker lives on beside the JVM's next stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow, with give_back at each task's end."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run
