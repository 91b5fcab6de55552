"""Words of texts as arrays: boundaries, 64-bit word hashes and hashes of word runs, without a Python loop over words.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D. All of these are single bytes in UTF-8
and never part of another character, so texts are cut as bytes. A run's hash is the polynomial of its members'
values at a fixed odd base modulo 2**64, taken from prefix sums, then mixed; equal runs hash alike wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RNG.integers(0, 2**64, 256, dtype=U) | U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: Odd bases of the polynomials: of bytes in a word, and of words in a run (two, for 128 bits).
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied to each element."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    up, down = _POWERS.get(base, (np.ones(1, U), np.ones(1, U)))
    if len(up) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        up, down = both
        if size <= 1 << 21:
            _POWERS[base] = up, down
    return up[:n], down[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[1]) -> np.ndarray:
    """A hash of values[starts[i]:ends[i]] for each i; the length counts too."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))


class Words:
    """The words of some texts. offsets: bytes of each text in data; first: each text's first word, with the end; starts, ends: bytes of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~SPACE[data]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        start[inner] = word[inner]
        end[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One hash for each word; lower: A-Z count as a-z."""
        return run_hashes((_LOWER if lower else _BYTES)[self.data], self.starts, self.ends, BASES[0])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of consecutive rows of a string column, with about ``limit`` bytes of text each. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    if not len(a):
        return
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return h.view(np.int64)
