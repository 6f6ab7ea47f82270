"""Vectorised words of Arrow text columns.

Words are maximal runs of bytes other than space and TAB..CR, which in UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` on code points. Each word gets a 64-bit hash: a polynomial over random
byte values, from differences of one running sum, then a finalising mix. Work goes over
segments of about a megabyte, so memory follows the segment and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Column values of the batches that Python gets.
CHUNK_BYTES = 1 << 20


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public SplitMix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables() -> dict:
    import sys
    import types

    # Functions travel by value, so what a worker keeps between tasks hangs on a module of its own.
    kept = sys.modules.setdefault("_rasterloom_words", types.ModuleType("_rasterloom_words"))
    if not hasattr(kept, "space"):
        kept.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        kept.space = np.zeros(256, bool)
        kept.space[[32, *range(9, 14)]] = True
        kept.lower = np.arange(256, dtype=np.uint8)
        kept.lower[65:91] += 32
        kept.powers = np.cumprod(np.full(SEGMENT + 1, BASE, np.uint64))
    return kept.__dict__


@dataclass
class Words:
    """Words of some rows: byte ranges in data, the row of each, its hash; offsets of the rows in data."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """Index of the first word of each row, and the end."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Words of rows that lie one after another in data."""
    t = _tables()
    if lower:
        data = t["lower"][data]
    n = len(data)
    inside = ~t["space"][data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1] | first[1:n]
        end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, offsets, starts, ends, row, hash_ranges(data, starts, ends))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte ranges."""
    t = _tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(starts, base + SEGMENT, side="left")))
        part = data[base : ends[stop - 1]]
        powers = t["powers"] if len(part) <= SEGMENT else np.cumprod(np.full(len(part), BASE, np.uint64))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(t["values"][part] * powers[: len(part)], out=total[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (total[e] - total[s]) * t["powers"][SEGMENT - s] + (e - s).astype(np.uint64)
        at = stop
    return mix64(out)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most so many bytes (or one row), with their bytes and offsets."""
    data, offsets = buffers(texts)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        stop = min(stop, rows)
        yield at, stop, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def word_chunks(texts: pa.Array, lower: bool, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    for at, stop, data, offsets in chunks(texts, most):
        yield at, stop, split_words(data, offsets, lower)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles; fewer words count as one shingle."""
    h, mul, mask = words.hash, 0xA0761D6478BD642F, (1 << 64) - 1
    seed = lambda length: length * 0x2545F4914F6CDD1D & mask
    bounds = words.bounds()
    count = max(0, len(h) - k + 1)
    rolled = np.full(count, seed(k), np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(mul) + h[i : i + count]
    rolled = mix64(rolled)
    sets = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            found = np.sort(rolled[lo : hi - k + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            sets.append(found[keep])
        elif hi > lo:
            one = seed(hi - lo)
            for x in h[lo:hi].tolist():
                one = one * mul + x & mask
            sets.append(mix64(np.array([one], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
