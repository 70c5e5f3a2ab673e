"""Words and hashes of many texts at once, as NumPy arrays over one byte buffer (runs in the Python workers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Space and the control characters tab to carriage return.
GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _BACK)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, bytes, offsets) for runs of rows of about ``size`` bytes; a longer text is alone.

    Nulls are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = GAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the number of words) of the runs of bytes that are no gaps."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    np.logical_not(gaps[buf], out=inside[1:-1])
    begins = inside[1:] & ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    if len(edge):  # a text's edge ends a word
        both = edge[inside[edge] & inside[edge + 1]]
        begins[both] = True
    ends_at = inside[:-1] & ~inside[1:]
    if len(edge):
        ends_at[both] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends_at)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial in the bytes."""
    up, down = _power(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, over text edges too; the caller drops those."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m, out = len(hashes) - n + 1, np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + m]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
