"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a batch are sorted, which is the depth-first order of their trie.  Each word keeps the
forward states of the prefix it shares with the word before and computes only the rest.

For unigram models the state of a prefix is its best score and last piece (Viterbi).  BPE models have no scores to add
up: there the state is the last piece of the prefix's own segmentation, and of the pieces that end a longer prefix the
right one is that which, put after the state where it begins, survives the merges: a segmentation by merges is right if
and only if each two neighbours are.  Both give what the SentencePiece library gives.

Defined cases: a null text is an empty one and has no pieces; characters outside the vocabulary become byte pieces, or
the unknown piece if the model has none; null or repeated ids are rows like any others; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .buffers import raw, slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Bytes of text that are encoded together: the larger, the fewer distinct words to look up for each word.
SLICE = 4 << 20
#: Ids that the cache of words holds before it starts anew.
MOST_IDS = 4_000_000
ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, text binary"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.type, rules = UNIGRAM, {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
        for number, value in _fields(data):
            if number == 1:
                piece = {2: struct.pack("<f", 0), 3: 1} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules |= dict(_fields(value))
        if self.type not in (UNIGRAM, BPE) or not rules[5]:
            raise ValueError("only unigram and BPE models with escaped white space are read")
        #: Normalisation other than this is left to the library.
        self.plain = not rules[2] and bool(rules[3]) and not rules[4]
        self.path = path
        self.place = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (1, 4)}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        #: Ends of pieces: a longer part of a word than one of these ends with no piece.
        self.tails = {p[i:] for p in self.place for i in range(len(p))}
        if any(MARK in p.lstrip(MARK) for p in self.place):
            raise ValueError("pieces that go on after a word's mark are not read")
        self.splits_lines = not any("\n" in p for p in self.place)
        self.least = min((self.scores[i] for i in self.place.values()), default=0.0) - 10.0
        self.met: dict[tuple[int, int], bool] = {}
        self.text = [(" " * len(p) if not p.strip(MARK) else p.replace(MARK, " ")).encode() if k in (1, 4) else bytes([int(p[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]

    def merged(self, text: str) -> list[str]:
        """Segmentation by merges, the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                p = self.place.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.scores[p] > best):
                    best, where = self.scores[p], i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether piece may follow before (-1: nothing that merges) in a segmentation by merges."""
        known = self.met.get((before, piece))
        if known is None:
            own = [self.pieces[piece]] if before < 0 else [self.pieces[before], self.pieces[piece]]
            known = self.met[before, piece] = self.merged("".join(own)) == own
        return known

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the distinct words."""
        out: list[list[int]] = [[]] * len(words)
        last, score, start = [-1], [0.0], [0]  # by length of prefix: last piece (-1: not in the vocabulary), Viterbi score, where it begins
        place, scores, tails, bpe, met = self.place, self.scores, self.tails, self.type == BPE, self.met
        previous = ""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            same = 0
            for a, b in zip(previous, word, strict=False):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], score[same + 1 :], start[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                found, begin, best = -1, i - 1, score[i - 1] + self.least
                ending, j = [], i - 1
                while j >= 0 and (part := word[j:i]) in tails:
                    p = place.get(part)
                    if p is not None:
                        ending.append((j, p))
                    j -= 1
                if bpe:
                    for j, p in reversed(ending):
                        ok = met.get((last[j], p))
                        if ok is None:
                            ok = self.fits(last[j], p)
                        if ok:
                            found, begin, best = p, j, 0.0
                            break
                else:
                    for j, p in ending:
                        if score[j] + scores[p] > best or (found < 0 and j == i - 1):
                            found, begin, best = p, j, score[j] + scores[p]
                last.append(found)
                score.append(best)
                start.append(begin)
            ids: list[int] = []
            i = len(word)
            while i:
                if last[i] >= 0:
                    ids.append(last[i])
                elif self.byte:
                    ids += [self.byte[b] for b in reversed(word[start[i] : i].encode())]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
                i = start[i]
            out[k] = ids[::-1]
            previous = word
        return out


UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
UNITS_OF_LINES = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Encoder:
    """Ids of whole texts, each distinct word segmented once."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.units = UNITS if self.model.splits_lines else UNITS_OF_LINES
        self.library = None
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.parts: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.sizes: list[int] = []
        self.flat, self.starts, self.size_of = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: list[str]) -> None:
        """Remember marked words, segmented unit by unit."""
        split = [self.units.findall(w) for w in words]
        distinct = list({u for units in split for u in units})
        ids = dict(zip(distinct, self.model.segment(distinct), strict=True))
        rows = [ids[units[0]] if len(units) == 1 else [i for u in units for i in ids[u]] for units in split]
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size_of = np.concatenate([self.size_of, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))])

    def encode(self, texts: pa.Array) -> pa.ListArray:
        if len(self.flat) > MOST_IDS:
            self.clear()
        texts = pc.fill_null(texts, "")
        rows = len(texts)
        odd = np.ones(rows, bool)
        if self.model.plain:
            odd = np.asarray(pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, MARK)))
        empty = np.asarray(pc.equal(texts, ""))
        usual = ~odd & ~empty
        at = np.flatnonzero(usual)
        split = pc.split_pattern(texts.take(pa.array(at)), " ")
        per = np.asarray(pc.list_value_length(split)).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = [MARK + w for w in coded.dictionary.to_pylist()]
        loose = {int(i): self.units.findall(self.normalised(texts[int(i)].as_py())) for i in np.flatnonzero(odd & ~empty)}
        self._add(list({w: 0 for w in [*words, *(u for units in loose.values() for u in units)] if w not in self.place}))
        known = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        of = known[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
        counts = np.zeros(rows, np.int64)
        counts[at] = per
        for i, units in loose.items():
            counts[i] = len(units)
        order = np.zeros(int(counts.sum()), np.int64)
        begin = np.cumsum(counts) - counts
        order[np.repeat(begin[at] - (np.cumsum(per) - per), per) + np.arange(len(of))] = of
        for i, units in loose.items():
            order[begin[i] : begin[i] + len(units)] = [self.place[u] for u in units]
        sizes = self.size_of[order]
        after = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[order] - after[:-1], sizes) + np.arange(int(after[-1]))]
        offsets = after[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))

    def normalised(self, text: str) -> str:
        if self.model.plain:
            return MARK + text.replace(" ", MARK)
        if self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=self.model.path)
        return self.library.normalize(text)


class Decoder:
    """Bytes of whole id sequences: pieces put end to end, marks as blanks, without the first word's mark."""

    def __init__(self, model: Model):
        self.flat = np.frombuffer(b"".join(model.text), np.uint8)
        self.sizes = np.fromiter(map(len, model.text), np.int64, len(model.text))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[ids]
        after = np.concatenate([[0], np.cumsum(sizes)])
        data = self.flat[np.repeat(self.starts[ids] - after[:-1], sizes) + np.arange(int(after[-1]))]
        edge = after[offsets]
        lead = edge[:-1][(np.diff(edge) > 0)]
        lead = lead[data[lead] == 32]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[edge]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def _decoder(path: str) -> Decoder:
    return Decoder(Model(path))


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _encoder(path).encode(rows.column("text"))], ["doc_id", "ids"])

    return run


def _decode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids = rows.column("ids")
                offsets = np.asarray(ids.offsets).astype(np.int64)
                data, edge = _decoder(path).decode(np.asarray(ids.values)[offsets[0] : offsets[-1]], offsets - offsets[0])
                text = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*rows.columns, text], ["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """ENCODED of docs (doc_id long, text string)."""
    return docs.select("doc_id", "text").mapInArrow(_encode(model_path), ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """DECODED of ENCODED: the text of the ids, as bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model_path), DECODED)
