"""Vectorised hashes of words, word shingles and lines, straight from Arrow's text buffers.

A text's hash prefix sums (sum of c[i] * B**i modulo 2**64, B odd) give the hash of any slice by one
subtraction and one multiplication with B**-start, so that no Python loop runs over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about so many bytes; a longer text is a piece of its own.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of the base and of its inverse, as long as needed so far."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = np.full(n, _BASE, U), np.full(n, _INVERSE, U)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


POWERS = Powers()
_BYTE = mix(np.arange(1, 257, dtype=U))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """codes: one scrambled 64-bit value for each unit. P[j] - P[i], times B**-i, is the hash of units i to j."""
    up, _ = POWERS.upto(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def slices(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices start to end."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD1B54A32D192ED03))


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows. A null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_utf8())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        to = min(to, n)
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def words(offsets: np.ndarray, data: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that are not `between`: ASCII white space; A-Z lower-cased), and where each text's words begin."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    word = ~between[low]
    first = np.empty(len(low), bool)
    first[0] = True
    first[1:] = ~word[:-1]
    first[offsets[:-1][offsets[:-1] < len(low)]] = True
    last = np.empty(len(low), bool)
    last[-1] = True
    last[:-1] = first[1:] | ~word[1:]
    start, end = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    return slices(prefix_sums(_BYTE[low]), start, end), np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles); a text of fewer words is one shingle, without words the set is empty."""
    for row, offsets, data in pieces(column):
        hashes, begin = words(offsets, data)
        runs = _runs(hashes, k)
        for i in range(len(offsets) - 1):
            a, b = begin[i], begin[i + 1]
            if b - a >= k:
                yield row + i, np.unique(runs[a : b - k + 1])
            elif b > a:
                yield row + i, _runs(hashes[a:b], b - a)[:1]
            else:
                yield row + i, hashes[:0]


def _runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, across texts too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = np.full(n, k, U)
    for j in range(k):
        out = mix(out * U(0xA24BAED4963EE407) + hashes[j : n + j])
    return out
