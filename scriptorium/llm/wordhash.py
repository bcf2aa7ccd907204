"""Vectorised word and window hashes over Arrow string columns.

Texts are handled as UTF-8 bytes: the separators are ASCII, so byte and
character views agree. Work proceeds in blocks of a few megabytes of whole
texts, which bounds memory by the block or the longest single text.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def release() -> None:
    """Give memory that was freed back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, whose worker keeps nothing of a task once it is done."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each text's first word (length texts + 1)."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[edges] = solid[edges]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = solid[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    power = np.full(int(lengths.max()), _P, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    value = _BYTE[data[within + np.repeat(starts, lengths)]] * power[within]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * U(0xA24BAED4963EE407) + U(seed))


def window_hashes(h: np.ndarray, k: int, factor: int = int(_Q)) -> np.ndarray:
    """Hash of each run of k values, by doubling; windows cross text bounds, which the caller masks."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc, width = h, 1
    for bit in bin(k)[3:]:
        acc = acc[: len(acc) - width] * U(pow(factor, width, 1 << 64)) + acc[width:]
        width *= 2
        if bit == "1":
            acc = acc[: len(acc) - 1] * U(factor) + h[width:]
            width += 1
    return mix(acc[:n])


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
