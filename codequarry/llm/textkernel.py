"""Vectorised text hashing on Arrow string columns (NumPy, no per-row Python).

Texts of a record batch lie back to back in one Arrow buffer.  A prefix sum of
``R[byte] * B**i`` modulo 2**64 gives the hash of any substring by two look-ups,
since an odd ``B`` has an inverse.  Work is done in chunks of a quarter megabyte,
so that memory stays bounded whatever the batch holds (one text is the least).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: blank and the controls from tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            have = np.full(size, base, dtype=np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (SplitMix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The batch function ``run``, giving freed memory back when a task ends, so
    that idle Python workers do not hold what the JVM could use."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


@dataclass
class Chunk:
    """Consecutive texts of a batch: rows ``first`` on, bytes, and borders."""

    first: int
    data: np.ndarray  # uint8, all texts back to back
    offsets: np.ndarray  # int64, len = number of texts + 1

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def as_strings(column: pa.Array) -> pa.Array:
    """The column as large strings, null as the empty text."""
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into chunks of at most ``limit`` bytes or one text."""
    column = as_strings(column)
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield Chunk(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


class Prefix:
    """Prefix sums of a byte array, for substring hashes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_RANDOM[data] * _power(_BASE, n, "base")[:n], out=self.sums[1:])
        self.inverse = _power(_INV, n + 1, "inverse")

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed 64-bit hashes of the substrings [start, end)."""
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
            return mix(raw + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Mixed hashes of every substring of ``width`` bytes, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def words(chunk: Chunk, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first."""
    data = chunk.data if data is None else data
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(chunk.n + 1, np.int64)
    solid = ~IS_SPACE[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[chunk.offsets] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | border[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | border[1:])) + 1
    return start, end, np.searchsorted(start, chunk.offsets)


def lowered(chunk: Chunk) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return LOWER[chunk.data]


_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    Words are runs of non-space bytes, A-Z lower-cased.  A text with fewer
    words has one shingle, its whole sequence; one without words has none.
    """
    for chunk in chunks(column):
        data = lowered(chunk)
        start, end, first = words(chunk, data)
        if len(start):
            word = Prefix(data).hashes(start, end)
            m = len(word) - width + 1
            with np.errstate(over="ignore"):
                total = np.zeros(max(m, 0), np.uint64)
                for k in range(width if m > 0 else 0):
                    total += word[k : k + m] * _MULTIPLIERS[k]
            total = mix(total + _U(width))
        for i in range(chunk.n):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                yield np.unique(total[a : b - width + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    one = (word[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64) + _U(b - a)
                yield mix(np.array([one], dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)
