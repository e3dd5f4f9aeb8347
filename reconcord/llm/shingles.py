"""Word shingles of Arrow batches as 64-bit hashes, computed with numpy.

Words are runs of bytes other than ASCII white space with A-Z lower-cased.  A
text's set holds its distinct shingles of ``size`` words; a text with fewer
words is one shingle; a text without words, or a null, has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in slices of about this many bytes, which bounds the memory of a task (a longer text is a slice of its own).
SLICE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values with well spread bits."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(salt * 2 + 1) * _STEP).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about SLICE bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of the texts data[offsets[i]:offsets[i+1]]; ``fold`` lower-cases A-Z."""
    low = int(offsets[0])
    raw, at = data[low : int(offsets[-1])], offsets - low
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    byte = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw) if fold else raw
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]  # a word ends with its text
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[byte] * _powers(_BASE, len(raw)), dtype=np.uint64)
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        value = mix((total[end] - before) * _powers(_INVERSE, len(raw))[start], 3)
    return value, np.searchsorted(at, start, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text."""
    n = len(offsets) - 1
    word, text = word_hashes(data, offsets)
    count = np.bincount(text, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    factor = mix(np.arange(size, dtype=np.uint64), 11) | np.uint64(1)
    with np.errstate(over="ignore"):
        m = max(0, len(word) - size + 1)
        value = np.zeros(m, np.uint64)
        for k in range(size):
            value += word[k : k + m] * factor[k]
        value = mix(value, 5).view(np.int64)
        out = []
        for i in range(n):
            if count[i] >= size:
                out.append(np.unique(value[at[i] : at[i + 1] - size + 1]))
            elif count[i]:
                few = word[at[i] : at[i + 1]]
                out.append(mix(np.array([np.sum(few * factor[: len(few)], dtype=np.uint64)]), 20 + len(few)).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
    return out


def fingerprint(values: np.ndarray, salt: int) -> int:
    """Order-free 64-bit fingerprint of a set of hashes and its size."""
    with np.errstate(over="ignore"):
        total = np.sum(mix(values.view(np.uint64), salt), dtype=np.uint64)
        return int(mix(np.array([total], np.uint64), len(values)).view(np.int64)[0])
