"""Words of whole texts in numpy: byte positions and 64-bit hashes, a bounded slice of bytes at a time.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR; A-Z count as a-z in hashes.
The hash is polynomial modulo 2**64 with a finalising mix, so equal words have equal hashes everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Spaces and all other ASCII signs but letters and digits: what separates words where punctuation is ignored.
NOT_ALNUM = np.array([not chr(k).isalnum() if k < 128 else False for k in range(256)])
_powers: list[np.ndarray] = []
#: glibc's call, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


class Words(NamedTuple):
    """Words of one slice of rows: ``row`` counts from the slice's first row; ``first`` has each row's first word."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64; those of a slice are kept, longer runs are made anew."""
    if n <= SLICE_BYTES + 2 and _powers:
        return _powers[0][:n], _powers[1][:n]
    rows = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(max(n, SLICE_BYTES + 2), base & _MASK, dtype=np.uint64)
        row[0] = 1
        rows.append(np.cumprod(row))
    if n <= SLICE_BYTES + 2:
        _powers[:] = rows
    return rows[0][:n], rows[1][:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Running sums of ``code * base**position``; :func:`span_hash` takes any span's hash from them."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    values = codes.astype(np.uint64)
    values += np.uint64(1)
    values *= powers(len(codes))[0]
    np.cumsum(values, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``size`` bytes; a longer text comes alone."""
    data, at = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        end = min(end, rows)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
    give_back()


def give_back() -> None:
    """Return what Arrow and the C library keep for reuse: workers live on between tasks, and over the stages of a job it adds up."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def words(data: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE) -> Words:
    """The words of one slice, in order; ``between`` tells for each byte whether it separates words."""
    rows = len(at) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), np.zeros(rows + 1, np.int64))
    inside = ~between[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = at[:-1] < at[1:]
    head, tail = at[:-1][filled], at[1:][filled] - 1
    opens[head] = inside[head]
    closes[tail] = inside[tail]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = span_hash(prefix_hashes(_LOWER[data]), start, end)
    first = np.searchsorted(start, at)
    return Words(np.repeat(np.arange(rows), np.diff(first)), start, end, hashes, first)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``n`` words; a row with 1..n-1 words has one gram, all its words."""
    total, each = len(w.hash), np.diff(w.first)
    mixed = np.zeros(max(0, total - n + 1), dtype=np.uint64)
    for k in range(n):
        mixed = mix(mixed + w.hash[k : k + len(mixed)] + np.uint64(k + 1))
    whole = w.row[: len(mixed)] == w.row[n - 1 :] if len(mixed) else np.zeros(0, bool)
    rows, out = w.row[: len(mixed)][whole], mixed[whole]
    short = np.flatnonzero((each > 0) & (each < n))
    if not len(short):
        return rows, out
    extra = np.zeros(len(short), dtype=np.uint64)
    for k in range(n):
        has = each[short] > k
        here = extra[has] + w.hash[w.first[:-1][short][has] + k] + np.uint64(k + 1)
        extra[has] = mix(here)
    extra = mix(extra + np.uint64(0xABCD))
    rows, out = np.concatenate([rows, short]), np.concatenate([out, extra])
    order = np.argsort(rows, kind="stable")
    return rows[order], out[order]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
