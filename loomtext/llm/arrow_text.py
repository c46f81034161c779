"""Whole-text work on Arrow string columns with numpy, in slices that fit a core's cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomtext.functions.batches import BATCH_BYTES, lean, mapped  # noqa: F401

#: Bytes of text handled at once. Only the size of temporaries depends on it, never a result.
SLICE_BYTES = 1 << 19

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column) -> pa.LargeStringArray:
    """One chunk of 64-bit-offset strings; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice and each text's bounds in them, ``len(column) + 1`` of them."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    lo, hi = int(bounds[0]), int(bounds[-1])
    body = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return body, bounds - lo


def slices(column: pa.LargeStringArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text has a range of its own."""
    if len(column) == 0:
        return
    _, offsets, _ = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        end = min(len(column), max(start + 1, end))
        yield start, end
        start = end


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    step = np.uint64(0x100000001B3)
    for i in range(1, n):
        out[i] = out[i - 1] * step
    return out


with np.errstate(over="ignore"):
    _POWERS = _powers(4096)


#: Bytes that separate words when punctuation is to be ignored: all of ASCII but letters, digits and the apostrophe.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[128:] = False
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = False


def words(body: np.ndarray, bounds: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and the texts' bounds among them; see :func:`placed_words`."""
    return placed_words(body, bounds, separators)[:2]


def placed_words(body: np.ndarray, bounds: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of each text, the texts' bounds among them, and the byte at which each word starts.

    A word is hashed over all its bytes and its length; text ends separate words as separator bytes do.
    """
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), np.zeros(0, np.int64)
    inside = ~separators[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), starts
    at = np.arange(n, dtype=np.int64)
    lengths = np.diff(np.append(starts, n))
    at[starts[0] :] -= np.repeat(starts, lengths)
    at[: starts[0]] = 0
    with np.errstate(over="ignore"):
        wide = (body.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 4095]
        if lengths.max() >= 4096:  # longer words: each block of 4096 bytes has another factor
            wide *= mix64((at >> 12).astype(np.uint64)) | np.uint64(1)
        wide[~inside] = 0
        sums = np.add.reduceat(wide, starts)
        filled = np.add.reduceat(inside.astype(np.int64), starts).astype(np.uint64)
        hashes = mix64(sums + filled * _PRIME)
    return hashes, np.searchsorted(starts, bounds).astype(np.int64), starts


def word_hash(word: str) -> int:
    """The hash that :func:`words` gives one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]))[0][0])
