"""Sets of five-word shingles and their fast similarity sketches, for many texts at once."""

from __future__ import annotations

import numpy as np

from .buffers import mix

WORDS = 5
#: Coordinates of a sketch and their grouping into bands: at similarity 0.75 all bands differ for 5 pairs in a million.
COORDS, ROWS = 128, 4
BANDS = COORDS // ROWS
#: Texts of a slice: their number shares 64 bits with a shingle's hash.
MOST_TEXTS = 1 << 13
_HASH_BITS = 51

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x5851F42D4C957F2D)
_PLACES = np.random.default_rng(6).integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text it is in)."""
    plain = ~_SPACE[data]
    first = plain.copy()
    first[1:] &= ~plain[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = plain[edge]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    number = np.cumsum(first) - 1
    inside = np.flatnonzero(plain)
    place = inside - begin[number[inside]]
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(place.max()) + 1, _STEP))])
    terms = _VALUE[_LOWER[data[inside]]] * power[place]
    starts = np.flatnonzero(place == 0)
    return mix(np.add.reduceat(terms, starts) + np.diff(np.append(starts, len(inside))).astype(np.uint64)), np.searchsorted(offsets, begin, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all texts, how many each has): 51-bit hashes, ascending within a text."""
    texts = len(offsets) - 1
    if texts > MOST_TEXTS:
        raise ValueError(f"at most {MOST_TEXTS} texts at a time")
    words, of = _word_hashes(data, offsets)
    per = np.bincount(of, minlength=texts)
    before = np.cumsum(per) - per
    parts, owners = [], []
    at = np.flatnonzero(np.arange(len(words)) - before[of] <= per[of] - WORDS) if len(words) else np.zeros(0, np.int64)
    if len(at):
        parts.append(mix(sum(words[at + j] * _PLACES[j] for j in range(WORDS)) + np.uint64(WORDS)))
        owners.append(of[at])
    for n in range(1, WORDS):
        short = np.flatnonzero(per == n)
        if len(short):
            parts.append(mix(sum(words[before[short] + j] * _PLACES[j] for j in range(n)) + np.uint64(n)))
            owners.append(short)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(texts, np.int64)
    packed = np.concatenate(owners).astype(np.uint64) << np.uint64(_HASH_BITS) | np.concatenate(parts) >> np.uint64(64 - _HASH_BITS)
    packed.sort()
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    owner = (packed >> np.uint64(_HASH_BITS)).astype(np.int64)
    return (packed & np.uint64(2**_HASH_BITS - 1)).astype(np.int64), np.bincount(owner, minlength=texts)


def digests(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets have equal sums."""
    starts = np.cumsum(sizes) - sizes
    out = []
    for seed in (0x3C79AC492BA7B653, 0x1C69B3F74AC4AE35):
        held = np.zeros(len(sizes), np.uint64)
        some = sizes > 0
        if some.any():
            held[some] = np.add.reduceat(mix(shingles.astype(np.uint64) ^ np.uint64(seed)), starts[some])
        out.append(held.view(np.int64))
    return out[0], out[1]


def sketches(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts by COORDS, uint64; rows of empty sets are all zero.

    In round i < COORDS every shingle falls into a bin by its hash of that round; in round COORDS + j every shingle falls
    into bin j.  A bin keeps the least (round, hash), so every bin is filled at the last round at the latest, and rounds
    after the first that leaves no bin empty change nothing.
    """
    texts = len(sizes)
    out = np.zeros((texts, COORDS), np.uint64)
    owner = np.repeat(np.arange(texts), sizes)
    open_texts = sizes > 0
    empty = np.uint64(2**64 - 1)
    out[open_texts] = empty
    start, width = 0, 1
    while open_texts.any() and start < 2 * COORDS:
        width = min(width, 2 * COORDS - start)
        chosen = open_texts[owner]
        x, who = shingles[chosen].astype(np.uint64), owner[chosen].astype(np.uint64)
        for low in range(start, start + width, 16):  # bounds the memory of a step
            rounds = np.arange(low, min(low + 16, start + width), dtype=np.uint64)
            v = mix(x[None, :] ^ mix(rounds + np.uint64(0x632BE59BD9B4E019))[:, None])
            fixed = rounds >= COORDS
            bins = np.where(fixed[:, None], rounds[:, None] - np.uint64(COORDS), v >> np.uint64(57))
            packed = ((who[None, :] * np.uint64(COORDS) + bins) << np.uint64(40) | rounds[:, None] << np.uint64(32) | v & np.uint64(2**32 - 1)).ravel()
            packed.sort()
            place = packed >> np.uint64(40)
            lead = np.concatenate([[True], place[1:] != place[:-1]])
            flat = out.reshape(-1)
            at = place[lead].astype(np.int64)
            flat[at] = np.minimum(flat[at], packed[lead] & np.uint64(2**40 - 1))
        start += width
        width = start
        open_texts &= (out == empty).any(axis=1)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Texts by BANDS: a 64-bit key of each band's number and coordinates."""
    held = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(0x7A5662CF)), held.shape[:2])
    for j in range(ROWS):
        key = mix(key ^ mix(held[:, :, j] + np.uint64(j)))
    return key.view(np.int64)
