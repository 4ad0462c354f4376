"""Words and shingles of Arrow string batches as 64-bit hashes, with numpy.

A word's hash is a polynomial in random 64-bit byte values, taken from running sums, so a whole
chunk of texts costs a few vector passes. Within one pair of sets of n shingles, two different
shingles share a hash with a chance of about n * n / 2**63.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = _rng.integers(1, 2**62, 64, dtype=np.uint64) * U(2) + U(1)

#: Space and the controls from tab to carriage return end a word.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z in lower case; every other byte is itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit moves about half the output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, U(_BASE), dtype=np.uint64)
    down = np.full(size, U(pow(_BASE, -1, 2**64)), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for size places at least."""
    return _powers(1 << max(16, (size - 1).bit_length()))


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row (exclusive), UTF-8 bytes and row offsets of parts of about limit bytes; null is empty.

    A row is never cut, so one very long text makes one larger part.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        own = offsets[at : stop + 1]
        yield at, stop, data[own[0] : own[-1]], own - own[0]
        at = stop


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each word of a chunk, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop)
    return start, stop, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to stop, A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[LOWER[data]] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return mix((total[stop + 1] - total[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk, and for each row the index of its first word (one more at the end)."""
    start, stop, first = places(data, offsets)
    return hashes(data, start, stop), first


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row its distinct k-word shingles as sorted hashes; with fewer words the whole sequence is one; none without words."""
    total = np.zeros(max(0, len(word) - k + 1), dtype=np.uint64)
    for j in range(k if len(total) else 0):
        total += word[j : len(word) - k + 1 + j] * STEP[j]
    total = mix(total)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(total[a : b - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own
        elif b > a:
            yield mix((word[a:b] * STEP[32 : 32 + b - a]).sum(dtype=np.uint64, keepdims=True) + U(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)
