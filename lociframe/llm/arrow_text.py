"""Vectorised text helpers for Arrow batches: bounded chunks, word boundaries and word hashes.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, everywhere in this folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def pieces(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``size`` text bytes: (rows, UTF-8 bytes, row offsets). A longer single text makes a slice of its own."""
    column = pc.fill_null(batch.column(text), "" if not pa.types.is_binary(batch.column(text).type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


@dataclass
class Words:
    """Word bounds of a slice; ``first[i]:first[i + 1]`` are the words of row i."""
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> Words:
    """Runs of bytes outside the table ``apart``, cut at the ends of rows."""
    inside = ~apart[data]
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:len(data)])
    edge[offsets] = True
    start = np.flatnonzero(edge[:-1] & inside)
    end = np.flatnonzero(edge[1:] & inside) + 1
    return Words(start, end, np.searchsorted(start, offsets))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(size, base & _MASK, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return table(_BASE), table(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for many spans at once, from prefix sums of a polynomial."""
    size = 1 << max(19, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def sliding(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive hashes (order matters)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out) + hashes[k:k + n]
    return mix(out)


def run_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Mask over the windows of ``sliding`` that stay inside one row."""
    n = int(first[-1]) - width + 1
    ok = np.ones(max(n, 0), bool)
    if n > 0:
        for back in range(1, width):
            at = first[1:-1] - back
            ok[at[(at >= 0) & (at < n)]] = False
    return ok
