"""Token ids of whole texts, by encoding each distinct white-space chunk once.

For tokenizers whose pre-tokenizer drops white space and never lets a token span it, the ids of a text are the ids of
its chunks in order; a chunk is encoded by the tokenizer itself and its ids kept for as long as the cache's bound lasts.
"""

from __future__ import annotations

import gc
import os
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .buffers import give_back, mix, raw

#: Ids the cache holds before it starts anew; chunks of more bytes than LONG are encoded but not kept.
MOST_IDS = 5_000_000
LONG = 64
#: Chunks that are put together into one text for the tokenizer, where their ids can be told apart.
TOGETHER = 512
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]{0,7}\z"
#: Chunks of one run of letters, and of one with a run of ASCII marks after it (an apostrophe may begin a token of its own), by
#: the least words in them; letters before marks are such as any version of Unicode takes for letters.
RUNS = {1: r"\A\pL+\z", 2: r"\A\pL*[A-Za-zÀ-ÖØ-öø-ſ][!-&(-/:-@\[-`{-~]+\z"}

_VALUE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _spans(offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indexes of all bytes of these rows, row by row."""
    size = offsets[rows + 1] - offsets[rows]
    after = np.cumsum(size)
    return np.repeat(offsets[rows] - (after - size), size) + np.arange(int(size.sum()))


def chunk_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk."""
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    terms = mix(_VALUE[data] + _STEP * place.astype(np.uint64))
    total = np.zeros(len(size), np.uint64)
    if len(data):
        total[size > 0] = np.add.reduceat(terms, offsets[:-1][size > 0])
    return mix(total + size.astype(np.uint64))


class ChunkEncoder:
    """The cache holds chunks by sorted hashes in arrays, a fifth of what a dictionary takes; a chunk that is found is compared byte by byte."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer looks for before it lowers letters, in any case.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, added))
        self.last = self._last_pieces(added)
        self.clear()

    def _last_pieces(self, added: list[str]) -> np.ndarray | None:
        """Which ids end a word, if every word has exactly one such id, which is its last one, and no chunk of RUNS holds a special string."""
        model = self.tokenizer.model
        suffix = getattr(model, "end_of_word_suffix", None)
        if not suffix or model.unk_token is not None or model.dropout or not all(re.search(r"\W\w", t) and not re.search(r"\s", t) for t in added):
            return None
        from tokenizers.pre_tokenizers import ByteLevel

        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        if not all(x in vocabulary and x + suffix in vocabulary for x in ByteLevel.alphabet()):
            return None
        out = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        out[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        return out

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.uint32)  # sorted hashes, and where these chunks are
        self.bytes, self.begins = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.uint32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes, self.ends = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, bool)
        self.lengths = np.zeros(1 << 14, np.uint8)
        self.used = self.n = self.held = 0

    def _append(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            held = np.concatenate([held, np.zeros(max(at + len(values) - len(held), len(held) // 2), held.dtype)])
            setattr(self, name, held)
        held[at : at + len(values)] = values

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of these hashes among those held, whether they are there)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _find(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where each chunk is, or -1 (always so for empty ones)."""
        out = np.full(len(keys), -1, np.int64)
        at, there = self._at(keys)
        rows = np.flatnonzero(there & (np.diff(offsets) > 0))
        entry = self.entry[at[rows]].astype(np.int64)
        same = self.lengths[entry] == (offsets[rows + 1] - offsets[rows])
        rows, entry = rows[same], entry[same]
        if len(rows):
            size = offsets[rows + 1] - offsets[rows]
            first = np.cumsum(size) - size
            held = self.bytes[np.repeat(self.begins[entry] - first, size) + np.arange(int(size.sum()))]
            same = np.logical_and.reduceat(data[_spans(offsets, rows)] == held, first)
            out[rows[same]] = entry[same]
        return out

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _together(self, chunks: list[str], words: int) -> tuple[np.ndarray, np.ndarray] | None:
        """_encoded(chunks) of chunks with at least so many words each; None if any has more."""
        ids, _ = self._encoded([" ".join(chunks[i : i + TOGETHER]) for i in range(0, len(chunks), TOGETHER)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != words * len(chunks):
            return None
        return ids, np.diff(ends[words - 1 :: words], prepend=0)

    def _ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kind = np.zeros(len(chunks), np.int64)
        if self.last is not None:
            for words, pattern in RUNS.items():
                kind[np.asarray(pc.match_substring_regex(chunks, pattern))] = words
        parts = []
        for words in range(len(RUNS) + 1):
            rows = np.flatnonzero(kind == words)
            for at in np.split(rows, range(TOGETHER * 16, len(rows), TOGETHER * 16)) if len(rows) else []:
                own = chunks.take(pa.array(at)).to_pylist()
                parts.append((at, *((self._together(own, words) if words else None) or self._encoded(own))))
        order, ids, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
        turn = np.argsort(order)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return ids[_spans(offsets, turn)], sizes[turn]

    def _add(self, chunks: pa.Array) -> None:
        ids, sizes = self._ids_of(chunks)
        data, offsets = raw(chunks)
        self._append("ids", self.used, ids)
        self._append("starts", self.n, self.used + np.cumsum(sizes) - sizes)
        self._append("sizes", self.n, sizes)
        self._append("ends", self.n, np.asarray(pc.match_substring_regex(chunks, SENTENCE_END)))
        self._append("bytes", self.held, data)
        self._append("begins", self.n, self.held + offsets[:-1])
        self._append("lengths", self.n, np.minimum(np.diff(offsets), LONG + 1))

    def _keep(self, keys: np.ndarray) -> None:
        """Of what was added last, chunks with these hashes, which come first and do not repeat, stay."""
        if not len(keys):
            return
        last = self.n + len(keys) - 1
        turn = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[turn])
        self.keys, self.entry = np.insert(self.keys, at, keys[turn]), np.insert(self.entry, at, (self.n + turn).astype(np.uint32))
        self.used = int(self.starts[last]) + int(self.sizes[last])
        self.held = int(self.begins[last]) + int(self.lengths[last])
        self.n = last + 1

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        """White-space chunks of each text, lowered as the tokenizer lowers all letters, so that those that differ in ASCII case meet early.

        Chunks with a special string in any case stay as they are: it counts only if its own letters match.
        """
        if not self.special or not pc.any(pc.match_substring_regex(texts, self.special, ignore_case=True)).as_py():
            return pc.ascii_split_whitespace(pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        flat = pc.if_else(pc.match_substring_regex(flat, self.special, ignore_case=True), flat, pc.ascii_lower(flat))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split)))]), pa.int32()), flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, ids per row, id positions after which a sentence ends, how many of those per row)."""
        split = self._chunks(pc.fill_null(texts, ""))
        per_row = np.asarray(pc.list_value_length(split)).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        data, offsets = raw(coded.dictionary)
        if max(self.used, self.n) > MOST_IDS:
            self.clear()
        keys = chunk_keys(data, offsets)
        known = self._find(data, offsets, keys)
        missing = np.flatnonzero(known < 0)
        size = np.diff(offsets)[missing]
        kept = missing[(size > 0) & (size <= LONG) & ~self._at(keys[missing])[1]]  # another chunk may have its hash
        kept = kept[np.unique(keys[kept], return_index=True)[1]]
        if len(missing):
            missing = np.concatenate([kept, np.setdiff1d(missing, kept)])
            known[missing] = self.n + np.arange(len(missing))
            self._add(coded.dictionary.take(pa.array(missing)))
        of = known[np.asarray(coded.indices)]
        sizes = self.sizes[of].astype(np.int64)
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        ids = self.ids[np.repeat(self.starts[of] - (after - sizes), sizes) + np.arange(total)]
        edge = np.concatenate([[0], np.cumsum(per_row)])
        after = np.concatenate([[0], after])
        is_end = self.ends[of]
        ends = np.concatenate([[0], np.cumsum(is_end)])
        out = ids, np.diff(after[edge]), after[1:][is_end], np.diff(ends[edge])
        self._keep(keys[kept])
        return out


#: Seconds after a task's end at which a worker that has no other of the kind gives the encoder's memory back.
IDLE_SECONDS = 4.0
_lock, _users = threading.Lock(), [0]


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


@contextmanager
def encoder(path: str) -> Iterator[ChunkEncoder]:
    """The one of this Python worker, so that its tasks share what was encoded; workers live on for other stages' tasks."""
    with _lock:
        _users[0] += 1
    own = _encoder(path)
    try:
        yield own
    finally:
        with _lock:
            _users[0] -= 1
        later = threading.Timer(IDLE_SECONDS, _give_back, [own])
        later.daemon = True
        later.start()


def _give_back(own: ChunkEncoder) -> None:
    with _lock:
        if _users[0]:
            return
        _encoder.cache_clear()
        own.clear()
    del own
    gc.collect()
    give_back()
