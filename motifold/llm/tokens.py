"""Vectorised work on whole Arrow batches of texts: words, hashes of spans, chunks.

A batch of texts is one byte buffer with offsets; everything below is a few passes over that buffer, so that no
Python code runs per word.  Span hashes come from prefix sums of a random polynomial modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at a time, so that the arrays over them stay small; one text is never cut.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, end to end, and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``limit`` bytes."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, per text, the number of words before it (one more entry than texts)."""
    inside = ~_SPACE[data]
    begin, finish = inside.copy(), inside.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        finish[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size, base, U)
        out[0] = 1
        return np.cumprod(out, dtype=U)

    return run(_BASE), run(_BASE_INVERSE)


@lru_cache(maxsize=2)
def _letters(fold: bool) -> np.ndarray:
    table = np.random.default_rng(20260101).integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
    if fold:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Hasher:
    """Hashes of any spans of ``data``; ``fold`` makes A-Z equal to a-z."""

    def __init__(self, data: np.ndarray, fold: bool = False) -> None:
        size = 1 << max(len(data), CHUNK).bit_length()
        powers, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_letters(fold)[data] * powers[: len(data)], dtype=U, out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return scrambled(raw ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word and, per text, the number of words before it."""
    starts, ends, before = words(data, offsets)
    return Hasher(data, fold).spans(starts, ends), before


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort: several times faster here than the library's hash table."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    first = np.flatnonzero(keep)
    return values[first], np.diff(np.append(first, len(values)))


def inverse(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and, for each value, its place among them."""
    order = np.argsort(values)
    ranked = values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(values), np.int64)
    at[order] = np.cumsum(keep) - 1
    return ranked[keep], at


def per_text(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the texts whose entries ``before`` delimits."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[before[1:]] - total[before[:-1]]
