"""Word shingles of whole texts, as sets of 64-bit hashes, computed a batch at a time with numpy.

Words are the maximal runs of bytes other than space and \\t..\\r, after A-Z are
lower-cased; nothing else is folded. A text's set holds the distinct hashes of
its ``k``-word shingles; a text with one to k-1 words has its whole word
sequence as its only shingle; a null, empty or blank text has the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    first = np.zeros(len(offsets), dtype=np.int64)
    if n == 0:
        return np.zeros(0, np.uint64), first
    word = ~_SEPARATOR[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    starts[begins] = word[begins]  # a word ends with its text
    at = np.flatnonzero(starts)
    first[:] = np.searchsorted(at, offsets)
    if len(at) == 0:
        return np.zeros(0, np.uint64), first
    inside = np.arange(n, dtype=np.int64)
    inside -= np.repeat(at, np.diff(np.append(at, n))) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.repeat(at, np.diff(np.append(at, n)))])
    inside[~word] = 0
    power = np.ones(int(inside.max()) + 1, dtype=np.uint64)
    power[1:] = _BASE
    power = np.cumprod(power, dtype=np.uint64)
    value = (_FOLD[data].astype(np.uint64) + np.uint64(1)) * power[inside]
    value[~word] = 0
    return mix(np.add.reduceat(value, at)), first


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    words, first = word_hashes(*text_buffer(column))
    n = len(words) - k + 1
    if n > 0:
        rolled = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            rolled = mix(rolled * _BASE + words[i : i + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                whole = mix(whole * _BASE + words[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
