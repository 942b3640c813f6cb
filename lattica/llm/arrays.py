"""Columnar text helpers: whole Arrow batches of strings as byte arrays, hashed with numpy and no per-word Python.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. Hashes are 64-bit and fixed by
constants below, so every executor and every run agrees.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Masks of the first n bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SLICE_BYTES = 1 << 18


def give_back() -> None:
    """Returns memory that this process does not need any more to the system, where the C library can: a worker that waits for
    its next task then holds little."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function of batches that gives memory back when it is through, so that the worker holds little until its next task."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = (h ^ (h >> U(30))) * _MIX1
    h = (h ^ (h >> U(27))) * _MIX2
    return h ^ (h >> U(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and row offsets; null counts as empty. Memory that Arrow no longer needs goes back first."""
    give_back()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of raw on as one number; raw has eight bytes more than there are places of interest."""
    return np.ndarray((len(raw) - 7,), np.uint64, np.ascontiguousarray(raw), 0, (1,))


def first_bytes(size: np.ndarray) -> np.ndarray:
    """Masks of the first size bytes, eight at most."""
    return _KEEP[np.minimum(size, 8)]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight at a time."""
    size = end - start
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:-8] = raw
    eight = eights(padded)
    h = mix(size.astype(np.uint64) * _BASE ^ (eight[start] & first_bytes(size)))
    at, done = np.flatnonzero(size > 8), 8
    while len(at):
        left = size[at] - done
        h[at] = mix(h[at] * _MIX2 ^ (eight[start[at] + done] & first_bytes(left)))
        done += 8
        at = at[left > 8]
    return h


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each, so that temporaries stay small; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        to = min(max(to, row + 1), rows)
        yield row, to
        row = to


class Words:
    """Words of some rows: `start`, `end` (byte places), `row` (row of each word), `count` (words of each row)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n, rows = len(raw), len(offsets) - 1
        self.raw, self.offsets, self.rows = raw, offsets, rows
        if not n:
            self.start = self.end = self.row = np.zeros(0, np.int64)
            self.count = np.zeros(rows, np.int64)
            return
        ink = ~SPACE[raw]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = ink[:-1]
        self.start = np.flatnonzero(ink & (~before | cut[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = ink[1:]
        self.end = np.flatnonzero(ink & (~after | cut[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=rows)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each lower-cased word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return span_hashes(LOWER[self.raw], self.start, self.end)


def shingles(word_hash: np.ndarray, word_row: np.ndarray, count: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of `width` words of a row, in order; a row of fewer words has its whole sequence as one."""
    n = len(word_hash)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | U(1)
    out_h, out_r = [], []
    if n >= width:
        acc = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            acc += word_hash[k : n - width + 1 + k] * factors[k]
        same = word_row[: n - width + 1] == word_row[width - 1 :]
        out_h.append(mix(acc[same]))
        out_r.append(word_row[: n - width + 1][same])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.cumsum(count) - count
        for k in range(1, width):
            rows = short[count[short] == k]
            if len(rows):
                acc = np.full(len(rows), k * int(_MIX1) & (1 << 64) - 1, np.uint64)
                for j in range(k):
                    acc += word_hash[first[rows] + j] * factors[j]
                out_h.append(mix(acc))
                out_r.append(rows)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def distinct_sets(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, one after another, and the offsets of the rows in them; rows come in order."""
    ends = np.cumsum(np.bincount(row, minlength=rows))
    h, at = h.copy(), 0
    for to in ends.tolist():
        h[at:to].sort()
        at = to
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[keep], row[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd factors; a product with one of them puts hashes in another order."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, n, dtype=np.uint64) | U(1)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... of `size[k]` numbers, one row after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def minhash(h: np.ndarray, offsets: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(rows, n) min-hash values of sets of mixed hashes; rows without hashes get the largest value."""
    rows = len(offsets) - 1
    out = np.full((rows, n), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        starts, a = offsets[full], seeds(n, seed)
        for k in range(n):
            out[full, k] = np.minimum.reduceat(h * a[k], starts)
    return out


def band_keys(signature: np.ndarray, per_band: int) -> np.ndarray:
    """(rows, bands) int64 keys, each of `per_band` min-hash values and the band's number."""
    rows, n = signature.shape
    bands = n // per_band
    out = np.zeros((rows, bands), np.uint64)
    for b in range(bands):
        acc = np.full(rows, (b + 1) * int(_BASE) & (1 << 64) - 1, np.uint64)
        for k in range(per_band):
            acc = mix(acc * _MIX1 + signature[:, b * per_band + k])
        out[:, b] = acc
    return out.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def binary_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes; offsets count bytes."""
    data = np.ascontiguousarray(raw).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
