"""Texts of Arrow batches as flat byte arrays: words, hashes and per-document sums without Python strings.

All functions take `data` (uint8 bytes of several texts, one after another) and `offs` (int64 positions where
each text begins, with the end of the last). Work is done in slices of at most SLICE_BYTES, or one longer text,
so memory follows the slice and not the batch.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
MULTIPLIER = 0x9E3779B97F4A7C15 | 5
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**i and its inverse modulo 2**64 for i < n.

    Made anew for each slice, which takes milliseconds: functions travel to tasks by value, so a table kept in the module
    would stay behind in every task's copy until its worker collects garbage.
    """
    tables = []
    for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        steps = np.full(n, base, dtype=np.uint64)
        steps[:1] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    return tables[0], tables[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds, raw = column.buffers()[1:3]
    offs = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offs[0] : offs[-1]] if len(offs) else data[:0], offs - (offs[0] if len(offs) else 0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows that hold at most `limit` bytes or one text."""
    data, offs = flat(column)
    rows, start = len(offs) - 1, 0
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1)
        yield start, stop, data[offs[start] : offs[stop]], offs[start : stop + 1] - offs[start]
        start = stop


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross a text's end."""
    before = np.zeros(len(member), dtype=bool)
    after = np.zeros(len(member), dtype=bool)
    if len(member):
        before[1:], after[:-1] = member[:-1], member[1:]
        inner = offs[(offs > 0) & (offs < len(member))]
        before[inner] = False
        after[inner - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word [^\\x20\\x09-\\x0D]+."""
    starts, ends = runs(~SEPARATOR[data], offs)
    return starts, ends, owner(starts, offs)


def owner(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs[1:], positions, side="right")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHashes:
    """64-bit hashes of byte spans from one running sum; equal spans have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHashes(data).of(starts, ends)


def windows(hashes: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` successive items of one text, and the position of each window's first item."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * MULTIPLIER % (1 << 64)
        total += hashes[k : k + n] * np.uint64(factor)
    first = np.flatnonzero(of[:n] == of[size - 1 : size - 1 + n])
    return mix(total[first]), first


def per_text(values: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """Sum of `values` by text number, as int64."""
    return np.bincount(of, weights=values, minlength=texts).astype(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (data & 0xC0) != 0x80
