"""Word splitting and hashing over Arrow string columns with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are worked on in segments of about
half a megabyte (a longer text is a segment of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT_BYTES = 1 << 19
U64 = np.uint64

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and all bytes of non-ASCII characters: tokens without punctuation.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, int(n).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, U64)
            t[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.multiply.accumulate(t))
        if size > 1 << 20:
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)) | U64(1)


@dataclass
class Segment:
    """Rows lo..hi of a column with the words of each: words of row lo + r are bounds[r] to bounds[r + 1]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        data = LOWER[self.data] if lower else self.data
        up, down = _power_tables(len(data) + 1)
        sums = np.empty(len(data) + 1, U64)
        sums[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def segments(column: pa.Array, size: int = SEGMENT_BYTES, inside_word: np.ndarray = _IS_WORD) -> Iterator[Segment]:
    data, offsets = text_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        rel = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        inside = inside_word[part]
        before = np.empty(len(part) + 1, bool)
        before[0] = False
        before[1:] = inside
        after = np.empty(len(part) + 1, bool)
        after[-1] = False
        after[:-1] = inside
        before[rel] = False
        after[rel] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        yield Segment(lo, hi, part, rel, starts, ends, np.searchsorted(starts, rel))
        lo = hi


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words at its first word, whether the run stays within its row)."""
    n = len(hashes)
    out = np.zeros(n, U64)
    for j, c in enumerate(odd_constants(k, seed)[:n]):
        out[: n - j] += hashes[j:] * c
    ok = np.zeros(n, bool)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    ok[left >= k] = True
    return mix(out), ok


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each row as (values, bounds); a row of fewer words has its whole sequence as one."""
    values, ok = windows(hashes, bounds, k, seed)
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    constants = odd_constants(k, seed)
    for r in short:
        own = hashes[bounds[r] : bounds[r + 1]]
        first = bounds[r]
        values[first] = mix(np.array([(own * constants[: len(own)]).sum(dtype=U64) ^ U64(len(own))]))[0]
        ok[first] = True
    kept = np.flatnonzero(ok)
    values = values[kept]
    edges = np.searchsorted(kept, bounds)
    for r in range(len(edges) - 1):
        values[edges[r] : edges[r + 1]].sort()
    if not len(values):
        return values, edges
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[edges[:-1][edges[:-1] < len(values)]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return values[new], total[edges]
