"""Whole-batch text kernels: words, lines and n-grams of Arrow string columns as numpy arrays.

Tasks hand over Arrow batches; the functions here work on the UTF-8 bytes of many documents at once, in slices of
bounded size, so that no Python code runs per word. A hash is a sum of per-byte random words times per-position
random words (modulo 2^64) followed by a mixing step, so it depends on every byte of a span and on its order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

# Words of letters and digits: ASCII ones and all characters beyond ASCII; and the lower-casing of A-Z.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], dtype=np.uint64)))


@lru_cache(maxsize=8)
def _byte_words(seed: int) -> np.ndarray:
    return random_words(256, seed)


@lru_cache(maxsize=4)
def _position_words(size: int, seed: int) -> np.ndarray:
    return random_words(size, seed + 1) | np.uint64(1)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of rows of at most ``limit`` bytes; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes in ``member`` (256 booleans); no run crosses a row."""
    inside = member[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = at[(at > 0) & (at < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the \\n-split lines; an empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(at, breaks, side="right") - 1
    rows = np.concatenate([np.arange(len(at) - 1), row])
    starts = np.concatenate([at[:-1], breaks + 1])
    order = np.argsort(rows, kind="stable")  # a row's first line comes before the lines that its breaks open
    rows, starts = rows[order], starts[order]
    last = np.append(rows[1:] != rows[:-1], True)
    ends = np.where(last, at[rows + 1], np.append(starts[1:], 0) - 1)
    return starts, ends, rows


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; the spans are ordered and do not overlap."""
    out = np.zeros(len(starts), dtype=np.uint64)
    lengths = ends - starts
    full = np.flatnonzero(lengths > 0)
    if len(full):
        size = lengths[full]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        position = np.arange(int(size.sum())) - np.repeat(first, size)
        longest = int(size.max())
        value = _byte_words(seed)[data[position + np.repeat(starts[full], size)]]
        value *= _position_words(1 << max(6, (longest - 1).bit_length()), seed)[position]
        out[full] = np.add.reduceat(value, first)
    return mix(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, rows: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the word tuples at the given distances, e.g. (0, 1) for bigrams, (0, 2) for skips."""
    span = steps[-1]
    n = len(hashes) - span
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    first = np.flatnonzero(rows[:n] == rows[span:])
    total = np.zeros(len(first), dtype=np.uint64)
    for k, (step, odd) in enumerate(zip(steps, _position_words(64, 77)[: len(steps)], strict=True)):
        total += mix(hashes[first + step] + np.uint64(k + 1)) * odd
    return first, mix(total)


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row, for n rows."""
    return np.bincount(rows, weights=values, minlength=n)
