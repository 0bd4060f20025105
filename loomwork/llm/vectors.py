"""Word and shingle hashes of whole Arrow string columns, with numpy and without a Python string a word.

A word's hash takes its bytes eight at a time, each mixed into the state before the next; one of more than
``LANES`` times eight bytes gets its xxh3 digest. No algebra of the bytes carries over to the hashes, so texts
can't be built to collide by shape. Work goes in chunks of about a megabyte of text, so memory follows the
largest single text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Spans of so many times eight bytes are hashed in numpy, longer ones one by one.
LANES = 4
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def release_memory() -> None:
    """Give the worker's free memory back to the system at the end of a task; the next task may be another operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches, with its memory given back after the last one."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        release_memory()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Odd factors of the places of a short run.
STEP = mix(np.arange(1, 65, dtype=U) * U(_BASE)) | U(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """A hash of each span of bytes; equal bytes give equal hashes wherever they stand."""
    size = ends - starts
    out = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + U(_BASE))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    live = np.arange(len(size))
    for at in range(0, 8 * lanes, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        lane = eight[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
        out[live] = mix((out[live] ^ lane) * U(0xA24BAED4963EE407) + U(at))
    whole = memoryview(padded)
    for i in live[size[live] > 8 * lanes].tolist():
        out[i] = xxhash.xxh3_64_intdigest(whole[starts[i] : ends[i]])
    return out


def run_hashes(items: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run of item hashes, from place first to last; equal runs give equal hashes wherever they stand."""
    flat = np.ascontiguousarray(items, dtype=U).view(np.uint8)
    return span_hashes(flat, first * 8, (last + 1) * 8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts (and the last ends); null is ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


@dataclass
class Words:
    """Words of some rows: byte spans in ``data``, a hash each, and the words' range for every row."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # rows + 1: the words of row i are first[i] to first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one row."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(column: pa.Array, limit: int = CHUNK) -> Iterator[Words]:
    """The words between blanks of every row, run by run."""
    for lo, hi, data, offsets in chunks(column, limit):
        solid = ~BLANK[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begins = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | edge[1:])) + 1 if len(data) else begins
        yield Words(lo, hi, data, offsets, begins, ends, span_hashes(data, begins, ends), np.searchsorted(begins, offsets))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and rows + 1 bounds. A text of fewer words has one run of them all."""
    counts = w.counts
    n_out = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(n_out)))
    out = np.zeros(bounds[-1], dtype=U)
    full = counts >= size
    if full.any():
        total = len(w.hashes) - size + 1
        acc = np.zeros(total, dtype=U)
        for j in range(size):
            acc += w.hashes[j : j + total] * STEP[j]
        row = np.repeat(np.flatnonzero(full), n_out[full])
        inside = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n_out[full])))[:-1], n_out[full])
        out[bounds[row] + inside] = acc[w.first[row] + inside]
    for i in np.flatnonzero((counts > 0) & ~full):
        h = w.hashes[w.first[i] : w.first[i + 1]]
        terms = np.append(h, U(len(h))) * np.append(STEP[: len(h)], U(0xA24BAED4963EE407))
        out[bounds[i]] = terms.sum()
    return mix(out), bounds


def per_row(values: np.ndarray, bounds: np.ndarray, how: np.ufunc, empty) -> np.ndarray:
    """``how`` over the values of each row; ``empty`` for rows without any."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = how.reduceat(values, bounds[some])
    return out
