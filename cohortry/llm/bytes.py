"""Texts as flat byte arrays: slices of bounded size, word boundaries and 64-bit hashes, for tasks that work with numpy."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Texts are worked on in slices of about this many bytes (one text at least), so that a task's arrays stay small.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _give_back() -> None:
    """Hand the memory that this process has freed back to the system."""
    gc.unfreeze()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task's function, which gives back what its arrays took when it ends: Python workers stay, more of them than there are cores."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def mix(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other (splitmix64)."""
    values = np.asarray(values, np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = stream(11, 256)


def whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array from a column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and the offset of each text (one more than texts)."""
    column = column.cast(pa.large_string())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return found[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or one text."""
    sizes = np.diff(utf8(column)[1])
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield start, row
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes after lower-casing A-Z.

    ``is_word`` marks the 256 byte values that belong to words.  Returns the
    hash, the start and end byte of each word, and for each text the index of
    its first word (one more than texts).  Words never cross texts.
    """
    low = _LOWER[data]
    inside = is_word[low]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inside[heads]
    starts = np.flatnonzero(begin)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begin[1:]
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    weight = stream(23, int(sizes.max()))
    sums = np.add.reduceat(_BYTE[low[inside]] * weight[place], bounds[:-1])
    return mix(sums + sizes.astype(np.uint64)), starts, ends, np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words (across texts too; the caller picks the valid starts)."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    weight = stream(1000 + length, length)
    total = np.zeros(len(hashes) - length + 1, np.uint64)
    for k in range(length):
        total += hashes[k : len(hashes) - length + 1 + k] * weight[k]
    return mix(total)
