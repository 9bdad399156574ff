"""Word and shingle kernels over Arrow string batches.

A batch is cut into chunks of bounded size. In a chunk every text is followed by one separator byte, so that words never cross
texts and whole chunks are handled by array operations. Hashes are 64-bit and depend on the bytes of a word alone.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text in a chunk. A longer text is a chunk of its own.
CHUNK_BYTES = 512 << 10

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Everything but ASCII white space.
NOT_SPACE = _byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Digits, ASCII letters and all bytes of characters beyond ASCII.
ALPHANUMERIC = _byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)

_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 3))
            powers = []
            for base in (_BASE, _BASE_INVERSE):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                powers.append(np.multiply.accumulate(steps))
            if n > 4 * CHUNK_BYTES:  # a giant text: not kept
                return powers[0], powers[1]
            self.up, self.down = powers
        return self.up, self.down


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash base and of its inverse."""
    return _POWERS.get(n)


@dataclass
class Chunk:
    """Some texts of a batch. ``data``: their bytes, each text followed by a space; ``first``/``last``: where a text begins and ends."""

    row: int
    data: np.ndarray
    first: np.ndarray
    last: np.ndarray
    is_word: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins and ends."""
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[1:] = self.is_word[self.data]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    @cached_property
    def word_from(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.spans[0], np.append(self.first, len(self.data)))

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_from)

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts)

    @cached_property
    def _sums(self) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[self.data] * _POWERS.get(len(self.data))[0][: len(self.data)], out=total[1:])
        return total

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, down = self._sums, _POWERS.get(len(self.data))[1]
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _GOLDEN)

    @cached_property
    def hashes(self) -> np.ndarray:
        """One uint64 for each word."""
        return self._hash(*self.spans)

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash of its first ``size`` bytes) of the words that are longer."""
        start, end = self.spans
        at = np.flatnonzero(end - start > size)
        return at, self._hash(start[at], start[at] + size)

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(*(x.tolist() for x in self.spans), strict=True)]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``width`` words inside one text, and a hash of each."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.text_of_word[:n] == self.text_of_word[width - 1 :])
        return at, rolling(self.hashes, width)[at]

    def shingle_sets(self, width: int) -> list[np.ndarray]:
        """For each text its distinct shingles, sorted: windows of ``width`` words, or all words if they are fewer."""
        rolled = rolling(self.hashes, width) if len(self.hashes) >= width else np.zeros(0, dtype=np.uint64)
        sets = []
        for a, b in zip(self.word_from[:-1].tolist(), self.word_from[1:].tolist(), strict=True):
            if b - a >= width:
                sets.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                sets.append(rolling(self.hashes[a:b], b - a) ^ np.uint64(b - a))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
        return sets


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """An order-dependent hash of each ``width`` consecutive entries."""
    n = len(hashes) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(_BASE)
        out += hashes[k : k + n]
    return mix(out)


def chunks(column: pa.Array, is_word: np.ndarray, lower: bool, limit: int | None = None) -> Iterator[Chunk]:
    """The texts of a string column; null counts as empty."""
    limit = limit or CHUNK_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, raw_offsets, raw = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(raw_offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    everything = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(len(column), max(end, row + 1))
        lengths = np.diff(offsets[row : end + 1])
        first = offsets[row:end] - offsets[row] + np.arange(end - row)
        last = first + lengths
        data = np.full(int(lengths.sum()) + end - row, 0x20, dtype=np.uint8)
        keep = np.ones(len(data), dtype=bool)
        keep[last] = False
        piece = everything[offsets[row] : offsets[end]]
        data[keep] = _LOWER[piece] if lower else piece
        yield Chunk(row, data, first, last, is_word)
        row = end


def trim() -> None:
    """Gives freed memory back to the system, so that a worker does not keep its peak."""
    pa.default_memory_pool().release_unused()  # what Arrow holds for later
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Arrow batches joined until they hold about ``size`` bytes."""
    held, nbytes = [], 0
    for batch in batches:
        held.append(batch)
        nbytes += batch.nbytes
        if nbytes >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, nbytes = [], 0
            trim()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    trim()
