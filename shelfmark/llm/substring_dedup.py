"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Which strings can meet: every string of `least` bytes names an anchor, its GRAM-byte piece with the least hash (the first
of equals), so equal strings name equal anchors at the same distance.  Consecutive strings of a document with one anchor
form a segment.  An anchor seen once has no repeats.  Segments are reduced to distinct ones; a segment that occurs twice
repeats all its strings.

Which strings repeat: the distinct segments of an anchor are put together, in batches of whole anchors, and their suffixes
sorted.  Starting from single bytes, intervals of the Burrows-Wheeler transform are extended backward breadth-first; an
interval of length l sets the common prefix after its last suffix to l if that is still unset, and only such intervals are
extended, so common prefixes come out by increasing value and each is set once.  Expansion stops at `least`: what is unset
then is a repeat.

Anchors with more distinct segments than HOT_SEGMENTS, such as the edges of a passage that a third of the documents share,
are not gathered: each of their strings becomes a segment of its own, and equal ones meet by aggregation.

Defined cases: a null text is an empty one; texts shorter than `least` keep all bytes; null or repeated ids are documents
like any others (if any id repeats or is null, rows are numbered first; equal rows are copies of each other); an empty table
gives an empty result; a cut may split a UTF-8 character, whose torn bytes stay unless whole_characters is asked for.

Which strings repeat is told by 64-bit hashes of anchors and whole segments, and within an anchor byte by byte (above
HOT_SEGMENTS by hashes of the strings).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .buffers import lean, mix, raw, slices
from .store import discard, materialise

LEAST = 400
GRAM = 32
HOT_SEGMENTS = 4_000
#: Bytes of segments that are looked at together, except for a single anchor's; about a quarter of them go into a transform.
BATCH_BYTES = 2 << 20
#: Bytes of a document that are looked at together; its tiles overlap by LEAST - 1.
TILE = 1 << 18
SEGMENTS = "row long, start long, strings int, place short, anchor long, segment long"
SPANS = "anchor long, segment long, runs array<int>"
PIECES = "anchor long, segment long, place short, hot boolean, bytes binary"
CUT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary"}

_VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1), np.uint64(base)))])[: n + 1]


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if len(_TABLES.get(name, ())) < n:
        _TABLES[name] = _powers(base, max(n, TILE + LEAST))
    return _TABLES[name]


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    terms = _VALUE[data] * _table("up", _BASE, len(data))[: len(data)]
    return np.concatenate([[np.uint64(0)], np.cumsum(terms)])


def _span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[a:b] that does not depend on where it stands."""
    return mix((prefix[b] - prefix[a]) * _table("down", _INVERSE, len(prefix))[a] + (b - a).astype(np.uint64))


def _least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """min(key[i:i + width]) for every i that has a whole window."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, first start in it, strings, place of the anchor, anchor, segment hash) of all segments of texts put end to end, at most TILE + least bytes."""
    n, gram = len(data), min(GRAM, least)
    none = np.zeros(0, np.int64)
    if n < least:
        return (none,) * 6
    prefix = _prefix_hashes(data)
    at = np.arange(n - gram + 1)
    hashes = _span_hash(prefix, at, at + gram)
    low = np.uint64(2**22 - 1)
    chosen = (_least_in_windows(hashes & ~low | at.astype(np.uint64), least - gram + 1) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[: len(chosen)] == owner[least - 1 : least - 1 + len(chosen)]
    start = np.flatnonzero(whole)
    if not len(start):
        return (none,) * 6
    anchor, text = chosen[start], owner[start]
    lead = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    first = start[lead]
    last = start[np.append(lead[1:], len(start)) - 1]
    return text[lead], first - offsets[text[lead]], last - first + 1, anchor[lead] - first, hashes[anchor[lead]].view(np.int64), _span_hash(prefix, first, last + least).view(np.int64)


def _tiles(rows: pa.RecordBatch, column: str, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, where the first text's bytes begin in it); a text longer than TILE comes alone, tile by tile."""
    data, offsets = raw(rows.column(column))
    if len(data) <= TILE:
        yield data, offsets, 0
        return
    for a in range(0, len(data), TILE):
        piece = data[a : a + TILE + least - 1]
        yield piece, np.array([0, len(piece)]), a


def find_segments(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", TILE):
                ids = np.asarray(rows.column("row"))
                for data, offsets, shift in _tiles(rows, "text", least):
                    text, start, strings, place, anchor, segment = segments(data, offsets, least)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[text], pa.int64()), pa.array(start + shift, pa.int64()), pa.array(strings, pa.int32()), pa.array(place, pa.int16()), pa.array(anchor, pa.int64()), pa.array(segment, pa.int64())],
                        ["row", "start", "strings", "place", "anchor", "segment"],
                    )

    return run


def split_strings(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From wanted segments with their bytes to a row for each of their strings: anchor, segment, place, string hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "bytes", 1 << 18):
                data, offsets = raw(rows.column("bytes"))
                strings = np.diff(offsets) - least + 1
                which = np.repeat(np.arange(rows.num_rows), strings)
                place = np.arange(len(which)) - np.repeat(np.cumsum(strings) - strings, strings)
                at = offsets[which] + place
                got = _span_hash(_prefix_hashes(data), at, at + least)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("anchor").take(pa.array(which)), rows.column("segment").take(pa.array(which)), pa.array(place, pa.int32()), pa.array(got.view(np.int64))],
                    ["anchor", "segment", "place", "string"],
                )

    return run


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; symbols are 1 to 256, and 0 ends a segment: such ends differ from each other, earlier ones first."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, symbols.dtype)]).astype(np.uint64)
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(7):
        key = key << np.uint64(9) | np.where(alive, padded[j : j + n], np.uint64(0))
        alive &= padded[j : j + n] != 0
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | ~alive[order[1:]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 7
    ends = np.append(new[1:], True)
    tied = np.flatnonzero(~(new & ends))
    while len(tied):
        suffix = order[tied]
        key2 = rank[suffix] << 32 | rank[np.minimum(suffix + step, n - 1)]
        again = np.argsort(key2, kind="stable")
        order[tied] = suffix = suffix[again]
        key2 = key2[again]
        new = np.concatenate([[True], key2[1:] != key2[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def repeated_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order, whether it shares its first `least` symbols with the one before it."""
    n = len(symbols)
    last = symbols[order - 1].astype(np.int64)  # the transform; what stands before the first symbol is an end
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    size = np.bincount(last, minlength=257)
    after = np.cumsum(size)
    ends = np.arange(size[0])
    some = np.flatnonzero(size[1:]) + 1
    lo, hi = np.concatenate([ends, after[some] - size[some]]), np.concatenate([ends, after[some] - 1])
    fresh = unset[hi + 1]
    unset[hi[fresh] + 1] = False
    lo, hi = lo[fresh], hi[fresh]
    for _ in range(1, least):
        if not len(lo):
            break
        one = lo == hi
        single = lo[one]
        single = step[single[last[single] != 0]]
        lo, hi = lo[~one], hi[~one]
        if len(lo):
            wide = hi - lo + 1
            first = np.cumsum(wide) - wide
            rows = np.arange(int(wide.sum())) + np.repeat(lo - first, wide)
            to = step[rows]
            key = np.repeat(np.arange(len(lo)), wide) << 9 | last[rows]
            turn = np.argsort(key, kind="stable")
            key, to = key[turn], to[turn]
            lead = np.concatenate([[True], key[1:] != key[:-1]])
            tail = np.append(lead[1:], True)
            plain = (key[lead] & 511) != 0
            lo, hi = to[lead][plain], to[tail][plain]
        lo, hi = np.concatenate([single, lo]), np.concatenate([single, hi])
        fresh = unset[hi + 1]
        unset[hi[fresh] + 1] = False
        lo, hi = lo[fresh], hi[fresh]
    return unset[:n]


def repeated_starts(pieces: list[bytes], least: int) -> np.ndarray:
    """Over the pieces put end to end, each with an end symbol: whether the string of `least` bytes there starts anywhere else."""
    data = np.zeros(sum(len(p) + 1 for p in pieces), np.int16)
    at = 0
    for p in pieces:
        data[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
        at += len(p) + 1
    order = suffix_array(data)
    with_before = repeated_prefixes(data, order, least)
    out = np.zeros(len(data), bool)
    out[order] = with_before | np.append(with_before[1:], False)
    return out


def runs_of(flags: np.ndarray) -> np.ndarray:
    """[first, last] of each run of true values, flat."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).ravel()


def may_repeat(pieces: list[bytes], anchors: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """Which pieces can share a string with another one of their anchor.

    A string reaches from its anchor at least half of what the anchor leaves of it to one side; a piece of which neither
    half is another's shares none.
    """
    gram = min(GRAM, least)
    half = (least - gram) // 2
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(size) - size
    prefix, out = _prefix_hashes(data), np.zeros(len(pieces), bool)
    for a, b in ((places, places + gram + half), (places - (least - gram - half), places + gram)):
        fits = np.flatnonzero((a >= 0) & (b <= size))
        if len(fits):
            key = _span_hash(prefix, begin[fits] + a[fits], begin[fits] + b[fits]) ^ mix(anchors[fits].view(np.uint64))
            _, where, count = np.unique(key, return_inverse=True, return_counts=True)
            out[fits[count[where] > 1]] = True
    return out


def expand_intervals(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From anchor, segment, place, bytes, sorted by anchor, to SPANS of the segments that repeat something."""

    def solve(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        can = may_repeat([b for *_, b in held], np.array([h[0] for h in held]), np.array([h[2] for h in held]), least)
        held = [h for h, c in zip(held, can.tolist(), strict=True) if c]
        flags = repeated_starts([b for *_, b in held], least) if held else np.zeros(0, bool)
        rows, at = [], 0
        for anchor, segment, _, b in held:
            runs = runs_of(flags[at : at + len(b) - least + 1])
            if len(runs):
                rows.append((anchor, segment, runs.tolist()))
            at += len(b) + 1
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], ["anchor", "segment", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "place", "bytes")), strict=True):
                if size >= BATCH_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    return run


def cut_out(whole_characters: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows with bytes and spans (start and end of covered bytes, may overlap) to the other columns and CUT."""

    def left(text: np.ndarray, own: list[dict[str, int]]) -> tuple[bytes, int, int]:
        edge = np.zeros(len(text) + 1, np.int32)
        np.add.at(edge, [s["a"] for s in own], 1)
        np.add.at(edge, [s["b"] for s in own], -1)
        covered = np.cumsum(edge)[:-1] > 0
        return text[~covered].tobytes(), int(covered.sum()), len(runs_of(covered)) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "_bytes"):
                data, offsets = raw(rows.column("_bytes"))
                texts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                done = [left(t, own) if own else (t.tobytes(), 0, 0) for t, own in zip(texts, rows.column("_spans").to_pylist(), strict=True)]
                digests = [hashlib.sha256(k).hexdigest() for k, _, _ in done]
                kept = [k.decode("utf-8", "ignore").encode() if n and whole_characters else k for k, n, _ in done]
                values = ([len(t) for t in texts], [n for _, n, _ in done], [n for _, _, n in done], digests, kept)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                others = rows.drop_columns(["_bytes", "_spans"])
                yield pa.RecordBatch.from_arrays([*others.columns, *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], [*others.schema.names, *CUT])

    return run


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From text and wanted (segments of it) to PIECES."""
    for batch in batches:
        for rows in slices(batch, "text"):
            data, offsets = raw(rows.column("text"))
            out: list[tuple[int, int, int, bool, bytes]] = []
            for i, own in enumerate(rows.column("wanted").to_pylist()):
                base = int(offsets[i])
                out += [(w["anchor"], w["segment"], w["place"], w["hot"], data[base + w["start"] : base + w["end"]].tobytes()) for w in own]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int16(), pa.bool_(), pa.binary()), strict=True)], ["anchor", "segment", "place", "hot", "bytes"])


def repeated_spans(texts: DataFrame, least: int = LEAST, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(row, a, b): bytes a to b of text row are covered by strings that start elsewhere too; spans may overlap."""
    found = materialise(texts.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(lean(find_segments(least)), SEGMENTS), "repeat-segments")
    # Counts are dealt anew before they are joined: a join right on an aggregation is not split where one anchor has most rows.
    often = found.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor").repartition(F.xxhash64("anchor"))
    met = materialise(found.join(often, "anchor", "left_semi").select(found.columns), "repeat-met")  # few of all: most anchors occur once
    discard(found)
    distinct = met.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "strings", "place")).alias("at"))
    anchors = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).repartition(F.xxhash64("anchor"))
    shared = materialise(distinct.join(anchors, "anchor"), "repeat-shared")
    whole = shared.filter("copies > 1").select("anchor", "segment", F.array(F.lit(0), F.col("at.strings") - 1).alias("runs"))
    open_rows = shared.filter("kinds > 1")
    wanted = open_rows.groupBy(F.col("at.row").alias("row")).agg(
        F.collect_list(F.struct("anchor", "segment", F.col("at.place").alias("place"), (F.col("kinds") > hot_segments).alias("hot"), F.col("at.start").alias("start"), (F.col("at.start") + F.col("at.strings") + least - 1).alias("end"))).alias("wanted")
    )
    pieces = texts.select("row", F.col("text").cast("binary").alias("text")).join(wanted, "row").select("text", "wanted").mapInArrow(lean(_bytes_of), PIECES)
    pieces = materialise(pieces, "repeat-pieces")
    # Straight from a scan: after a join on anchor this exchange would be left out, and a skewed partition of the join split.
    spans = pieces.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    spans = spans.mapInArrow(lean(expand_intervals(least)), SPANS)
    strings = pieces.filter("hot").mapInArrow(lean(split_strings(least)), "anchor long, segment long, place int, string long")
    strings = strings.join(strings.groupBy("anchor", F.col("string").alias("s")).agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("anchor", "at"), F.expr("anchor = at and string = s"))
    single = strings.select("anchor", "segment", F.array("place", "place").alias("runs"))
    marked = materialise(whole.unionByName(spans).unionByName(single), "repeat-marked")
    discard(shared, pieces)
    runs = met.join(marked, ["anchor", "segment"]).select("row", "start", F.explode(F.expr("transform(sequence(0, size(runs) - 2, 2), i -> struct(runs[i] as f, runs[i + 1] as l))")).alias("run"))
    return runs.select("row", (F.col("start") + F.col("run.f")).alias("a"), (F.col("start") + F.col("run.l") + least).alias("b"))


def with_rows(docs: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, bool]:
    """(docs with _row long, which no two rows share; whether that is the id): where any id repeats or is null, rows are numbered in a written copy."""
    ids = docs.groupBy(id_column).agg(F.count("*").alias("n"))
    if ids.filter((F.col("n") > 1) | F.col(id_column).isNull()).isEmpty():
        return docs.withColumn("_row", F.col(id_column).cast("long")), True
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "repeat-numbered"), False


def removed(keyed: DataFrame, text_column: str = "text", least: int = LEAST, hot_segments: int = HOT_SEGMENTS, whole_characters: bool = False) -> DataFrame:
    """The columns of what with_rows returned but the text, then n_bytes, n_removed, n_spans, kept_sha256, kept.

    kept_sha256 is of all bytes that stay; kept holds them all, or with whole_characters not those of characters a cut has torn.
    """
    docs = keyed.withColumn("_bytes", F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))).drop(text_column)
    texts = docs.select(F.col("_row").alias("row"), F.col("_bytes").alias("text"))
    spans = repeated_spans(texts, least, hot_segments).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    docs = docs.join(spans, F.col("_row") == F.col("row"), "left").drop("row")
    others = [f"`{n}` {t}" for n, t in docs.dtypes if n not in ("_bytes", "_spans")]
    return docs.mapInArrow(lean(cut_out(whole_characters)), ", ".join([*others, *(f"{n} {t}" for n, t in CUT.items())]))


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, hot_segments: int = HOT_SEGMENTS, whole_characters: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (see removed)."""
    keyed, _ = with_rows(docs.select(id_column, text_column), id_column)
    return removed(keyed, text_column, least, hot_segments, whole_characters).drop("_row")
