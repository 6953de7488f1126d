"""Vectorised word and shingle fingerprints over Arrow text columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Its fingerprint is a 64-bit polynomial hash over per-byte
random odd numbers, finished by an avalanche step; two different words share one with probability about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLDED_KEYS = BYTE_KEYS[FOLD]
STEP = U64(0x9E3779B97F4A7C15)
#: Bytes worked on at a time: what a step makes of them fits the cache.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step: every input bit changes each output bit with probability about one half."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(1 << 12)


def release_memory() -> None:
    """Gives freed memory back to the system, at the end of a task: Python workers that wait for the next one would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside glibc
    if trim is not None:
        trim(0)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row starts with the end appended) for runs of rows of about ``limit`` bytes. Null reads as empty.

    A row longer than the limit comes alone and whole; what works on it goes in pieces.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    blob = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, blob[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def _next_white(data: np.ndarray, at: int) -> int:
    """The place of the first white space from ``at`` on, or the end."""
    while at < len(data):
        hit = np.flatnonzero(WHITE[data[at : at + SLICE_BYTES]])
        if len(hit):
            return at + int(hit[0])
        at += SLICE_BYTES
    return len(data)


def word_hashes(data: np.ndarray, starts: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and for each row the index of its first word (with the end appended).

    One long row goes in pieces, cut before white space, so that only its fingerprints are held whole.
    """
    if len(starts) == 2 and len(data) > 2 * SLICE_BYTES:
        parts, at = [], 0
        while at < len(data):
            end = _next_white(data, at + SLICE_BYTES)
            parts.append(_word_hashes(data[at:end], np.array([0, end - at]), fold)[0])
            at = end
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    return _word_hashes(data, starts, fold)


def _word_hashes(data: np.ndarray, starts: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    inside = ~WHITE[data]
    edge = starts[:-1][starts[:-1] < len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edge] |= inside[edge]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = edge[edge > 0] - 1
    ends[edge] |= inside[edge]
    lengths = np.flatnonzero(ends) - first + 1
    at = np.cumsum(lengths) - lengths
    kept = np.flatnonzero(inside)
    longest = int(lengths.max())
    table = _POWERS if longest <= len(_POWERS) else powers(longest)
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(at, lengths)
    terms = (FOLDED_KEYS if fold else BYTE_KEYS)[data[kept]]
    terms *= table[place]
    return mix(np.add.reduceat(terms, at)), np.searchsorted(first, starts)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of ``width`` words in each row, in order, with row bounds.

    A row with fewer words, but at least one, gives its whole sequence as its only shingle.
    """
    counts = np.diff(bounds)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(sizes)))
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, dtype=np.uint64), out_bounds
    if len(counts) == 1 and total > SLICE_BYTES:  # one long row, in pieces
        parts = []
        for first in range(0, total, SLICE_BYTES):
            part = words[first : min(first + SLICE_BYTES, total) + width - 1]
            parts.append(shingle_hashes(part, np.array([0, len(part)]), width)[0])
        return np.concatenate(parts), out_bounds
    at = np.arange(total, dtype=np.int64) + np.repeat(bounds[:-1] - out_bounds[:-1], sizes)
    span = np.repeat(np.minimum(counts, width), sizes)
    padded = np.append(words, np.zeros(width, dtype=np.uint64))
    acc = span.astype(np.uint64)
    for k in range(width):
        acc = mix(acc) * STEP + np.where(k < span, padded[at + k], U64(0))
    return mix(acc), out_bounds


def distinct_in_rows(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, with new bounds."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    out = np.empty_like(values)
    for i in np.flatnonzero(sizes):
        part = values[bounds[i] : bounds[i + 1]]
        out[bounds[i] : bounds[i + 1]] = np.sort(part)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(sizes)))))


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def to_unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)
