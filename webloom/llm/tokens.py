"""Words and shingles of whole Arrow columns, with numpy and without a Python loop over words.

A word is a maximal run of bytes other than space and the control characters
9 to 13. Those bytes never occur inside a UTF-8 sequence, so splitting the
bytes splits the text. A word's hash is a sum of one pseudo-random 64-bit
number for each (position in the word, byte), finally mixed: sums of
independent random numbers, so equal hashes of different words are as rare as
for any 64-bit hash, whatever the text looks like.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_POSITIONS = 64
#: Bytes of text that are hashed at once; bounds the temporary arrays to some MB.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit numbers."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(_POSITIONS * 256, dtype=U64))
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some rows. Row i has words[first[i]:first[i + 1]]."""

    rows: slice  # of the batch
    raw: np.ndarray  # the bytes of these rows, as they are
    row_bytes: np.ndarray  # where each row begins in raw, and the end
    start: np.ndarray  # of each word in raw
    length: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


#: Separates at every ASCII character that is neither letter nor digit.
LETTERS_ONLY = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False, separator: np.ndarray = _SEPARATOR) -> Iterator[Words]:
    """The words of a string column, some rows at a time (a row is never split)."""
    raw, off = texts(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, side="right")) - 1)
        yield _words(raw[off[i] : off[j]], off[i : j + 1] - off[i], slice(i, j), lower, separator)
        i = j


def _words(raw: np.ndarray, bounds: np.ndarray, rows: slice, lower: bool, separator: np.ndarray) -> Words:
    inside = ~separator[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(raw)]
    begins[edge] = inside[edge]  # a row's first byte begins a word
    start = np.flatnonzero(begins)
    if not len(start):
        return Words(rows, raw, bounds, start, start, np.zeros(0, U64), np.zeros(len(bounds), np.int64))
    where = np.flatnonzero(inside)
    data = raw[where]
    if lower:
        data = _LOWER[data]
    at = np.searchsorted(where, start)  # of each word's first byte in data
    length = np.diff(np.append(at, len(where)))
    code = ((np.arange(len(where)) - np.repeat(at, length)) << 8) | data
    if int(length.max()) <= _POSITIONS:
        values = _TABLE[code]
    else:
        values = np.where(code < len(_TABLE), _TABLE[np.minimum(code, len(_TABLE) - 1)], mix(code.astype(U64)))
    hashes = mix(np.add.reduceat(values, at) + length.astype(U64))
    return Words(rows, raw, bounds, start, length, hashes, np.searchsorted(start, bounds).astype(np.int64))


def starts_of(w: Words, chosen: np.ndarray, size: int) -> np.ndarray:
    """A hash of the first ``size`` bytes of the chosen words, which must be that long."""
    start, total = w.start[chosen], U64(size << 32)
    for k in range(size):
        total = total + _TABLE[(k << 8) | w.raw[start + k].astype(np.int64)]
    return mix(total) if len(start) else np.zeros(0, U64)


def runs_of(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for each ``size`` consecutive words: element i covers words i to i + size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, U64((seed * 2 + 1) * 0xD1342543DE82EF95 % 2**64))
    odd = mix(np.arange(size, dtype=U64) + U64(seed << 16)) | U64(1)
    for k in range(size):
        total += hashes[k : k + n] * odd[k]
    return mix(total)


def shingle_sets(w: Words, size: int = 5) -> list[np.ndarray]:
    """For each row its sorted distinct shingles; a row of fewer words has its whole sequence as one."""
    runs, out = runs_of(w.hashes, size), []
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= size:
            part = np.sort(runs[a : b - size + 1])
            if len(part) > 1:
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
        elif b > a:
            part = runs_of(w.hashes[a:b], b - a, seed=b - a)
        else:
            part = np.zeros(0, U64)
        out.append(part)
    return out
