"""Vectorised text kernels shared by the operators of this folder.

An Arrow string column is one buffer of UTF-8 bytes and a list of offsets.  The kernels here work on that buffer with numpy,
half a megabyte at a time, so that no Python object is made for a word and a worker's arrays stay small.  Every kernel treats a
null text as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a kernel holds; a single longer text is a step of its own.
STEP_BYTES = 512 << 10

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = np.array([_splitmix(i + 1) | 1 for i in range(256)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Byte classes: true for the bytes of a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x41:0x5B] = True
ALPHANUMERIC[0x80:] = True

#: Powers that a worker keeps; the powers for a longer text are made for it alone.
_KEPT_POWERS = 4 << 20
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse modulo 2**64, kept by the worker up to a bound."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = _BASE if which == "up" else _INVERSE
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= _KEPT_POWERS:
            _powers[which] = have
    return have[:n]


def release() -> None:
    """Give back to the system what Arrow's pool, this module and the allocator hold; called at the end of a task, for workers
    are reused."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


class Texts:
    """A slice of texts as bytes: data, and offsets of len(texts) + 1 from 0."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        """A-Z in lower case; other bytes as they are."""
        return Texts(_LOWER[self.data], self.offsets)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of slices that hold about size bytes each."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


class Words:
    """Words of a Texts: byte spans, and words[first[i]:first[i + 1]] are those of text i."""

    def __init__(self, texts: Texts, is_word: np.ndarray):
        data, offsets = texts.data, texts.offsets
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = is_word[data]
        begin = inside[1:-1] & ~inside[:-2]
        stop = inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        if len(edges):
            begin[edges] |= inside[edges + 1]
            stop[edges - 1] |= inside[edges]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.texts = texts

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        return span_hashes(self.texts.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of byte spans, by one running sum over the bytes and a mixing step."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * _power("up", n), out=total[1:])
    return mix64((total[end] - total[start]) * _power("down", n + 1)[start])


def count_in(texts: Texts, table: np.ndarray) -> np.ndarray:
    """For each text, how many of its bytes are in the table."""
    total = np.zeros(len(texts.data) + 1, dtype=np.int64)
    np.cumsum(table[texts.data], out=total[1:])
    return np.diff(total[texts.offsets])


#: Bytes that begin a code point.
LEADING = (np.arange(256) & 0xC0) != 0x80


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the next span."""
    length = length.astype(np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = length > 0
    s, k = start[keep].astype(np.int64), length[keep]
    at = np.cumsum(k)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + k[:-1]) + 1
    return np.cumsum(out)
