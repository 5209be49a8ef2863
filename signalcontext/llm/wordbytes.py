"""Vectorised word and shingle hashing over the UTF-8 buffer of an Arrow string column.

White space is the six ASCII bytes 0x20 and 0x09-0x0D, so words can be found on the bytes themselves,
without decoding.  Every function works on whole texts; a batch is cut only between documents, and a document longer than a step is
hashed block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed odd multipliers of the polynomial and of the mixers.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that one vectorised step takes (a longer document is a step by itself, hashed in blocks of BLOCK bytes).
STEP_BYTES = 1 << 18
BLOCK = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


#: The first powers of the multiplier and of its inverse modulo 2**64, as many as a block needs.
with np.errstate(over="ignore"):
    _POWER, _UNPOWER = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(BLOCK, x), dtype=np.uint64)]) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))


def spans(value: np.ndarray, at: np.ndarray, to: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span at..to of the bytes (through the table, if there is one), the same wherever the span
    stands: the difference of a polynomial prefix sum, divided by the power at which the span begins.

    The spans are in order and do not overlap, so that of those in a block only the first can have begun before it."""
    out = np.zeros(len(at), np.uint64)
    total = np.zeros(min(len(value), BLOCK) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(value), BLOCK):
            part = value[lo : lo + BLOCK]
            n = len(part)
            np.cumsum(((part if table is None else table[part]).astype(np.uint64) + np.uint64(1)) * _POWER[:n], out=total[1 : n + 1])
            i, j = np.searchsorted(to, lo, side="right"), np.searchsorted(at, lo + n, side="left")
            if i == j:
                continue
            a, b = np.maximum(at[i:j] - lo, 0), np.minimum(to[i:j] - lo, n)
            more = (total[b] - total[a]) * _UNPOWER[a]
            if at[i] < lo:
                more[:1] *= np.uint64(pow(int(_BASE), int(lo - at[i]), 1 << 64))
            out[i:j] += more
        out += (to - at).astype(np.uint64)
    for i in range(0, len(out), BLOCK):
        out[i : i + BLOCK] = mix(out[i : i + BLOCK])
    return out


def steps(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in those bytes) for runs of rows; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step_bytes, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words before each row and after the last)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = offsets[:-1][(offsets[:-1] < offsets[1:])]
    begins[rows] = inside[rows]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = rows[1:] - 1
    ends[last] = inside[last]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return spans(data, at, to, _LOWER if lower else None), np.searchsorted(at, offsets, side="left")


def _row_shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of one text in order, with no more than two arrays of its length."""
    n = len(hashes) - width + 1
    acc = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            acc *= _BASE
            acc += hashes[k : n + k]
        for i in range(0, n, BLOCK):
            acc[i : i + BLOCK] = mix(acc[i : i + BLOCK] + np.uint64(width))
    acc.sort()
    keep = np.ones(n, bool)
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep]


def shingles(hashes: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each distinct shingle, ordered by row and hash.

    A row with fewer words than the width has one shingle, its whole word sequence; a row without words none.
    """
    counts = np.diff(before)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(counts) == 1 and n >= width:
        acc = _row_shingles(hashes, width)
        return acc, np.zeros(len(acc), np.int64)
    rows = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        place = np.arange(n)
        left = before[1:][rows] - place
        acc = np.zeros(n, np.uint64)
        for k in range(width):
            nxt = np.zeros(n, np.uint64)
            nxt[: n - k] = hashes[k:]
            nxt[left <= k] = 0
            acc = acc * _BASE + nxt
        acc = mix(acc + np.minimum(left, width).astype(np.uint64))
    use = (left >= width) | ((place == before[:-1][rows]) & (counts[rows] < width))
    acc, rows = acc[use], rows[use]
    order = np.lexsort((acc, rows))
    acc, rows = acc[order], rows[order]
    keep = np.ones(len(acc), bool)
    keep[1:] = (acc[1:] != acc[:-1]) | (rows[1:] != rows[:-1])
    return acc[keep], rows[keep]
