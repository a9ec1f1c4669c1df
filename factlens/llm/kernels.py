"""Vectorised text kernels over Arrow string buffers.

An Arrow string column is one byte buffer plus offsets, so tokenising and hashing run
as numpy passes over bytes, with no Python string for each document. Work is cut into
chunks of a few MB (a longer document is a chunk of its own), which bounds memory.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 512 << 10
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_KEYS = np.random.RandomState(20240501).randint(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

#: ASCII white space, the word separators: 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lean(run: Callable) -> Callable:
    """A task over Arrow batches that gives freed memory back to the system when it ends; a worker lives on for other tasks."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each; every row is in exactly one."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 65536), _P if kind == "up" else _P_INV, U64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=U64)
    return have


class Rolling:
    """Hashes of any byte spans of a buffer from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.sum = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE_KEYS[data] * _power("up", len(data) + 1)[: len(data)], out=self.sum[1:], dtype=U64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each span [start, end); equal bytes give equal hashes."""
        down = _power("down", len(self.sum))
        return mix((self.sum[end] - self.sum[start]) * down[start] + (end - start).astype(U64))


def pieces(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes within rows: starts, ends and row of each."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row: maximal runs of bytes that are not ASCII white space."""
    return pieces(~SPACE[data], offsets)


def per_row(values: np.ndarray | None, row: np.ndarray, n: int) -> np.ndarray:
    """The sum of values for each row, or how many there are."""
    return np.bincount(row, values, n).astype(np.int64) if values is not None else np.bincount(row, minlength=n)


def shingles(word_hash: np.ndarray, row: np.ndarray, n_rows: int, width: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `width` words in each row, with the row of each, in order.

    With whole, a row with fewer words (but some) gives its entire sequence as one window.
    """
    n = len(word_hash)
    out, of = np.zeros(0, U64), np.zeros(0, np.int64)
    if n >= width:
        keep = row[: n - width + 1] == row[width - 1 :]
        total = np.zeros(n - width + 1, U64)
        for k in range(width):
            total = total * _P + word_hash[k : n - width + 1 + k]
        out, of = mix(total[keep]), row[: n - width + 1][keep]
    if whole:
        counts = np.bincount(row, minlength=n_rows)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            first = np.searchsorted(row, short)
            extra = np.zeros(len(short), U64)
            for k in range(width - 1):
                more = counts[short] > k
                extra[more] = extra[more] * _P + word_hash[first[more] + k]
            out = np.concatenate([out, mix(extra + counts[short].astype(U64) * U64(0xD1342543DE82EF95))])
            of = np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return out, of


def distinct(values: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and the n_rows + 1 offsets; row must ascend."""
    at = np.searchsorted(row, np.arange(n_rows + 1))
    values = values.copy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    keep[first] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def repeated(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(k), bool)
    out[order] = same
    return out
