"""Words of whole texts as flat numpy arrays, for operators that work on Arrow batches.

A word is a run of bytes other than blank and the controls 9 to 13; every word gets a 64-bit
hash of its bytes. All of it is array arithmetic over the text buffer, a few MB at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
CHUNK_BYTES = 2 << 20


@dataclass
class Words:
    """Words of consecutive rows: ``doc`` is the row, ``start``/``end`` are byte offsets in ``data``."""

    data: np.ndarray
    bounds: np.ndarray  # n rows + 1 offsets into data
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n rows + 1 offsets into the word arrays


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: list[np.ndarray] = []


def _powers(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, one pair of tables per process, as long as its longest buffer."""
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS.clear()
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(size, CHUNK_BYTES + (1 << 18)), factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges ``[start, end)``; equal bytes give equal hashes anywhere."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    raw = (sums[end] - sums[start]) * inverse[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    _, bounds = buffers(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        yield row, min(to, n)
        row = min(to, n)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words_of(column: pa.Array, lower: bool = False, hashed: bool = True, terms: bool = False) -> Words:
    """All words of all rows of a string column; with ``terms``, runs of letters and digits instead."""
    data, bounds = buffers(column)
    if lower:
        data = lowered(data)
    if terms:
        inside = (
            ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
            | ((data >= 48) & (data <= 57)) | (data >= 128)
        )
    else:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    hashes = range_hashes(data, start, end) if hashed else np.empty(0, np.uint64)
    return Words(data, bounds, doc, start, end, hashes, first)


def per_row(values: np.ndarray, first: np.ndarray, how: np.ufunc, empty) -> np.ndarray:
    """``how.reduceat`` over the rows' slices, with ``empty`` for rows without values."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    full = np.diff(first) > 0
    if full.any():
        out[full] = how.reduceat(values, first[:-1][full], axis=0)
    return out
