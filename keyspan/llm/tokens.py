"""Words, shingles and their 64-bit hashes over Arrow text columns, vectorised over bytes.

A word's hash is a polynomial over its bytes modulo 2^64, taken as a difference of prefix sums, then mixed.
Texts are worked in pieces of bounded size, so a very long text, or word, costs little memory beside its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked at once.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as many as a piece with a separator after each of its texts has bytes."""
    mask = (1 << 64) - 1
    with np.errstate(over="ignore"):
        up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * PIECE + 2, b & mask, dtype=np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return offsets.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def _piece_words(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, polynomial) of each word of a piece's bytes."""
    up, down = _powers()
    sep = np.empty(len(data) + 2, dtype=bool)
    sep[0] = sep[-1] = True
    np.take(separators, data, out=sep[1:-1])
    edge = np.flatnonzero(sep[1:] != sep[:-1])
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return starts, ends, (total[ends] - total[starts]) * down[starts]


def _long_text(data: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text of several pieces; words may be longer than a piece."""
    parts: list[np.ndarray] = []
    open_word, open_bytes = 0, 0  # a word that the piece before ended in
    for lo in range(0, len(data), PIECE):
        piece = data[lo : lo + PIECE]
        starts, ends, words = _piece_words(piece, separators)
        last = int(ends[-1] - starts[-1]) if len(ends) else 0
        if open_bytes:
            if len(starts) and starts[0] == 0:
                words[0] = np.uint64((open_word + pow(_BASE, open_bytes, 1 << 64) * int(words[0])) & ((1 << 64) - 1))
                last += open_bytes if len(ends) == 1 else 0
            else:
                parts.append(np.array([open_word], dtype=np.uint64))
        if len(ends) and ends[-1] == len(piece):
            open_word, open_bytes, words = int(words[-1]), last, words[:-1]
        else:
            open_word, open_bytes = 0, 0
        parts.append(words)
    if open_bytes:
        parts.append(np.array([open_word], dtype=np.uint64))
    return mix(np.concatenate(parts))


def word_hashes(column: pa.Array, separators: np.ndarray = SPACES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, last row + 1, bounds, hashes): row first+k has words hashes[bounds[k]:bounds[k+1]].

    A-Z are lower-cased; words are maximal runs of bytes outside separators.
    """
    offsets, data = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1), row + PIECE)
        lo, hi = int(offsets[row]), int(offsets[last])
        if last == row + 1 and hi - lo > PIECE:
            hashes = _long_text(data[lo:hi], separators)
            yield row, last, np.array([0, len(hashes)]), hashes
        else:
            # texts must not run into each other: a separator goes between them
            own = offsets[row : last + 1] - lo
            gaps = np.arange(last - row + 1)
            room = np.full(hi - lo + last - row, 0x20, dtype=np.uint8)
            to = np.arange(hi - lo) + np.repeat(gaps[:-1], np.diff(own))
            room[to] = data[lo:hi]
            starts, _, words = _piece_words(room, separators)
            yield row, last, np.searchsorted(starts, own + gaps), mix(words)
        row = last


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of runs of k words in each row; a row of fewer words, but at least one, has its whole sequence as one."""
    counts = np.diff(bounds)
    own = np.maximum(counts - k + 1, 0) + ((counts > 0) & (counts < k))
    out_bounds = np.concatenate([[0], np.cumsum(own)])
    if not len(words):
        return np.zeros(0, np.uint64), out_bounds
    pad = np.concatenate([words, np.zeros(k, np.uint64)])
    step = np.uint64(0xD6E8FEB86659FD93)
    total, factor = np.zeros(len(words), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += pad[j : j + len(words)] * factor
            factor *= step
    place = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], own) + np.repeat(bounds[:-1], own)
    out = mix(total[place])
    for r in np.flatnonzero((counts > 0) & (counts < k)):  # fewer words than a shingle: the number of words is part of it
        seq = words[bounds[r] : bounds[r + 1]]
        with np.errstate(over="ignore"):
            total, factor = np.uint64(len(seq)), step
            for w in seq:
                total += w * factor
                factor *= step
            out[out_bounds[r]] = mix(np.array([total ^ np.uint64(0x5851F42D4C957F2D)]))[0]
    return out, out_bounds


def release() -> None:
    """Gives memory that a worker holds but doesn't use back to the system: a worker waits long between its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with memory given back when a task is done with its batches and nothing refers to them any more."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return to_the_end


def list_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column from flat 64-bit values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
