"""Words and shingles of whole Arrow batches, found and hashed with array arithmetic on the UTF-8 bytes.

A word is a maximal run of bytes of one class.  Its 64-bit value is a polynomial over per-byte constants (A-Z counts as
a-z), taken from running sums, then mixed; a window of k words gets a mixed linear form of its word values.  Equal texts
give equal values on every machine; different ones collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None
#: Bytes of text handled at once; a single longer text is still handled whole.
PASS_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit constants from a rule."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15)) | U(1)


BYTE_VALUE = stream(256, 1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
WINDOW_VALUE = stream(4096, 2)
BASE = int(stream(1, 3)[0])
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Words are what lies between spaces, tabs and line breaks.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0..n and BASE**-0..-n modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            out = np.full(max(n + 1, PASS_BYTES + 1), U(base), dtype=U)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


class Words:
    """The words of some texts: ``start`` and ``end`` byte places, ``first[i]:first[i+1]`` the words of text i, ``value`` their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashed: bool = True):
        self.data, self.offsets = data, offsets
        inside = kind[data]
        opens, closes = inside.copy(), inside.copy()
        if len(data):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = offsets[:-1][offsets[:-1] < offsets[1:]]
            opens[edges] = inside[edges]
            last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            closes[last] = inside[last]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        if hashed:
            up, down = powers(len(data))
            with np.errstate(over="ignore"):
                sums = np.zeros(len(data) + 1, dtype=U)
                np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
                self.value = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def windows(self, k: int) -> np.ndarray:
        """The value of the k words from each word on; windows that run past the end of a text are there too, mask them with :meth:`whole`."""
        n = len(self.value)
        out = np.zeros(n, dtype=U)
        with np.errstate(over="ignore"):
            for j in range(min(k, n)):
                out[: n - j] += self.value[j:] * WINDOW_VALUE[j % 4096]
            return mix(out + U(k))

    def owner(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def whole(self, k: int) -> np.ndarray:
        """Where a window of k words from the word on lies within its text."""
        ends = np.repeat(self.first[1:], self.count)
        return np.arange(len(self.start)) + k <= ends


def passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into stretches of about ``limit`` bytes: first row, row after the last, bytes, offsets within them.  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(places, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        high = min(high, n)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def words_of(column: pa.Array, kind: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, Words]]:
    for low, high, data, offsets in passes(column, limit):
        yield low, high, Words(data, offsets, kind)
