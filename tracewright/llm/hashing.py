"""Words of UTF-8 text as 64-bit hashes, computed with numpy on whole buffers instead of Python strings.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. These bytes never occur inside a UTF-8 sequence, so
byte positions give the same words as the pattern ``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at a time; it bounds the temporary arrays.
_BLOCK = 1 << 20
_held: dict = {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def held(name: object, build: Callable[[], T]) -> T:
    """What build() made, kept for the worker's next tasks until another name is asked for.

    Workers outlive tasks, so tables kept by one operator would else lie beside those of the next.
    """
    if name not in _held:
        _held.clear()
        _held[name] = build()
    return _held[name]


def give_back() -> None:
    """Returns freed memory to the system: allocators keep it, and a worker between tasks has no use for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
    if trim is not None:
        trim(0)


def trimmed(task: Callable[[T], object]) -> Callable[[T], object]:
    """A task function, of batches or of one group, after which the worker gives freed memory back."""

    @functools.wraps(task)
    def batches(given: T) -> Iterator:
        try:
            yield from task(given)
        finally:
            give_back()

    @functools.wraps(task)
    def group(given: T) -> object:
        out = task(given)
        give_back()
        return out

    return batches if inspect.isgeneratorfunction(task) else group


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """Polynomial word hashes modulo 2**64 over random byte values, then mixed."""

    def __init__(self, seed: int, lower: bool = False):
        rng = np.random.default_rng(seed)
        values = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.values = values[_LOWER] if lower else values
        self.base = int(rng.integers(1, 2**62)) * 2 + 1
        self.powers = self._powers(self.base, 1)
        self.inverse = self._powers(pow(self.base, -1, 2**64), 1)
        self.window_base = int(rng.integers(1, 2**62)) * 2 + 1

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo >= len(self.powers):
                n = max(hi - lo + 1, _BLOCK + 1)
                self.powers, self.inverse = self._powers(self.base, n), self._powers(pow(self.base, -1, 2**64), n)
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(self.values[data[lo:hi]] * self.powers[: hi - lo], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * self.inverse[starts[i:j] - lo]
            i = j
        out += (ends - starts).astype(np.uint64)
        return mix(out)

    def windows(self, words: np.ndarray, width: int) -> np.ndarray:
        """Hash of words[i : i + width] for each i that has them, by doubling."""
        if len(words) < width:
            return np.empty(0, dtype=np.uint64)
        span, part = 1, words
        total, done = None, 0
        while True:
            if width & span:
                shifted = part[done:] * np.uint64(pow(self.window_base, done, 2**64))
                total = shifted if total is None else total[: len(shifted)] + shifted[: len(total)]
                done += span
            if done == width:
                return mix(total[: len(words) - width + 1] + np.uint64(width))
            part = part[:-span] + part[span:] * np.uint64(pow(self.window_base, span, 2**64))
            span *= 2


def find_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie side by side, text k in data[bounds[k] : bounds[k + 1]].

    Also, for each k from 0 to the number of texts, how many words lie before bounds[k].
    """
    space = _SPACE[data]
    before = np.ones(len(data), dtype=bool)
    before[1:] = space[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    before[inner] = True
    starts = np.flatnonzero(~space & before)
    after = np.ones(len(data), dtype=bool)
    after[:-1] = space[1:]
    inner = bounds[1:][bounds[1:] > 0]
    after[inner - 1] = True
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of an Arrow string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about size bytes together, at least one text each."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j
