"""Rolling hashes of whole Arrow batches of texts, in numpy.

A text column is one run of UTF-8 bytes with offsets.  The prefix sums
``P[i] = sum(T[byte_j] * R**j, j < i)`` modulo 2**64 give the Rabin-Karp hash of any byte
range as ``(P[end] - P[start]) * R**-start``; the same step over word hashes gives the hash
of any window of words.  All of it is a handful of array operations per batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

_RADIX = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)


class _Cache(dict):
    """Sent to executors empty."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def _power_table(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n, kept between batches."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(values: np.ndarray, base: int = _RADIX) -> np.ndarray:
    """P with ``len(values) + 1`` entries; values are 64-bit."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power_table(base, len(values)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _RADIX) -> np.ndarray:
    inverse = _power_table(pow(base, -1, 2**64), len(prefix))
    return (prefix[ends] - prefix[starts]) * inverse[starts]


class Texts:
    """Some rows of a text column: bytes, row offsets, and word boundaries when asked."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the first word of each row (n + 1 entries)."""
        inside = ~SPACE[self.data]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        filled = self.offsets[1:] > self.offsets[:-1]
        before[self.offsets[:-1][filled]] = False
        after[self.offsets[1:][filled] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(range_hashes(prefix_hashes(_BYTE[self.data]), starts, ends))

    def char_starts(self) -> np.ndarray:
        return np.flatnonzero((self.data & 0xC0) != 0x80)

    def byte_prefix(self) -> np.ndarray:
        return prefix_hashes(_BYTE[self.data])


def slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Cut a text column into row ranges of about ``most_bytes``; a longer text is alone.

    Nulls are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def windows(hashes: np.ndarray, first: np.ndarray, length: int, seeds: tuple[int, ...] = (0,)) -> tuple:
    """Hashes of all ``length``-word windows that stay inside one row.

    Returns the first word of each window (an index over all rows' words), its row, and one
    hash array for each seed.
    """
    counts = np.diff(first)
    per_row = np.maximum(counts - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), per_row)
    start = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row) + first[:-1][row]
    out = []
    for seed in seeds:
        base = ((_RADIX * (2 * seed + 1)) % 2**64) | 5
        prefix = prefix_hashes(mix(hashes, seed + 1), base)
        out.append(mix(range_hashes(prefix, start, start + length, base), seed))
    return start, row, *out
