"""Token counts of a document's sections from one encoding of the whole document.

The document is encoded once; each token has a span of the text, and so has each section.  An interval join of the two
ordered lists (binary search of token starts and ends in the section starts) gives every token its first and last
section.  A token inside one section counts there.  A token that crosses sections counts in the one with most of its
bytes, the earlier of equals; each section reports how many tokens it shares with another.  Spans are kept in UTF-8 bytes,
since a token may be a part of a character; section starts and lengths are reported in characters.

Sections here are lines with their line ends.  Any other split works the same: `attribute` takes the section starts.

Defined cases: a null or empty text is one empty section without tokens; a text that ends in a line end has no empty
section after it; null or repeated ids are rows like any others; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .buffers import raw, slices

#: Token spans that the cache of words holds before it starts anew.
MOST_TOKENS = 4_000_000
#: Texts that are encoded whole: a blank inside or at the end of a run of white space may share a token with what is before it.
WHOLE = r"  |[\x09-\x0D\x{85}\pZ] ([\x09-\x0D\x{85}\pZ]|\z)"
COUNTS = "doc_id long, section long, start long, chars long, tokens long, crossing long"


class SpanEncoder:
    """Byte sizes of the tokens of whole texts with a byte-level tokenizer that splits words before their blank.

    A blank after anything but white space begins a token, and so does the last blank of a run of white space before a
    word.  Texts that have only such blanks are cut before each; each distinct word is encoded once.  Texts that match WHOLE
    are encoded whole.  Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # one character of a byte-level vocabulary stands for one byte
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def token_bytes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each token of all rows, tokens of each row)."""
        if len(self.flat) > MOST_TOKENS:
            self.clear()
        rows = len(texts)
        odd = np.asarray(pc.match_substring_regex(texts, WHOLE))
        at = np.flatnonzero(~odd)
        split = pc.split_pattern(texts.take(pa.array(at)), " ")
        per = np.asarray(pc.list_value_length(split)).astype(np.int64)
        flat = split.flatten()
        lead = np.zeros(len(flat), bool)
        lead[np.cumsum(per) - per] = True
        words = pc.binary_join_element_wise(pa.array(np.where(lead, "", " ").tolist(), pa.string()), flat, "").dictionary_encode()
        names = words.dictionary.to_pylist()
        missing = [w for w in names if w not in self.place]
        if missing:
            sizes = self._ids(missing)
            counts = np.fromiter(map(len, sizes), np.int64, len(sizes))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, self.bytes_of[np.fromiter((i for s in sizes for i in s), np.int64, int(counts.sum()))].astype(np.int32)])
            for w in missing:
                self.place[w] = len(self.place)
        known = np.fromiter((self.place[w] for w in names), np.int64, len(names))
        of = known[np.asarray(words.indices)] if len(names) else np.zeros(0, np.int64)
        counts = self.counts[of]
        after = np.cumsum(counts)
        got = self.flat[np.repeat(self.starts[of] - (after - counts), counts) + np.arange(int(after[-1]) if len(after) else 0)].astype(np.int64)
        after = np.concatenate([[0], after])
        edge = after[np.concatenate([[0], np.cumsum(per)])]
        tokens = np.zeros(rows, np.int64)
        tokens[at] = np.diff(edge)
        whole = np.flatnonzero(odd)
        if not len(whole):
            return got, tokens
        loose = {int(i): self.bytes_of[np.array(ids, np.int64)] for i, ids in zip(whole, self._ids(texts.take(pa.array(whole)).to_pylist()), strict=True)}
        usual = {int(i): got[a:b] for i, a, b in zip(at, edge[:-1], edge[1:], strict=True)}
        tokens[whole] = [len(loose[int(i)]) for i in whole]
        return np.concatenate([loose[i] if odd[i] else usual[i] for i in range(rows)]), tokens


def attribute(token_ends: np.ndarray, section_starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section of a stream.

    token_ends ascend; tokens and sections fill the stream from 0 to end without gaps.
    """
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_starts, starts, side="right") - 1
    last = np.maximum(np.searchsorted(section_starts, token_ends, side="left") - 1, first)
    home, n = first.copy(), len(section_starts)
    cross = np.flatnonzero(first != last)
    bounds = np.append(section_starts, end)
    touched = np.zeros(n + 1, np.int64)
    np.add.at(touched, first[cross], 1)
    np.add.at(touched, last[cross] + 1, -1)
    best = bounds[first[cross] + 1] - starts[cross]
    step = 1
    while True:  # the k-th section after the first of each crossing token
        some = first[cross] + step <= last[cross]
        if not some.any():
            break
        at = np.minimum(first[cross] + step, n - 1)
        part = np.minimum(bounds[at + 1], token_ends[cross]) - bounds[at]
        better = some & (part > best)
        best[better] = part[better]
        home[cross[better]] = at[better]
        step += 1
    return np.bincount(home, minlength=n), np.cumsum(touched)[:-1]


@lru_cache(maxsize=1)
def _encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


def _count(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = pc.fill_null(rows.column("text"), "")
                data, offsets = raw(texts)
                sizes, tokens = _encoder(path).token_bytes(texts)
                lead = (data & 0xC0) != 0x80
                chars = np.concatenate([[0], np.cumsum(lead)])  # characters that begin before each byte
                begin = offsets[:-1]
                after_line = np.flatnonzero(data == 10) + 1
                after_line = after_line[~np.isin(after_line, offsets)]
                starts = np.sort(np.concatenate([begin[np.diff(offsets) > 0], after_line]))
                of = np.searchsorted(offsets, starts, side="right") - 1
                per = np.bincount(of, minlength=rows.num_rows)
                place = chars[starts]
                count, crossing = attribute(np.cumsum(sizes), starts, len(data)) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                width = np.diff(np.append(place, chars[-1]))
                bare = np.flatnonzero(per == 0)
                doc = np.concatenate([of, bare])
                nil = np.zeros(len(bare), np.int64)
                columns = [
                    np.concatenate([np.arange(len(of)) - (np.cumsum(per) - per)[of], nil]),
                    np.concatenate([place - chars[begin[of]], nil]),
                    np.concatenate([width, nil]),
                    np.concatenate([count, nil]),
                    np.concatenate([crossing, nil]),
                ]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(doc)), *(pa.array(c.astype(np.int64)) for c in columns)], [x.split()[0] for x in COUNTS.split(", ")])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """COUNTS of docs (doc_id long, text string): a row for each line."""
    return docs.select("doc_id", "text").mapInArrow(_count(tokenizer_path), COUNTS)
