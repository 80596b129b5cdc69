"""Vectorised words of an Arrow text column: the common first step of the text operators.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``. Everything works on numpy views of the Arrow
buffers, a bounded number of bytes at a time, so a task holds a few tens of MB besides its Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))  # a copy, so what follows may change it
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, step in enumerate((_BASE, _INVERSE)):
            p = np.full(n, step, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


@dataclass
class Grid:
    """Words of a run of texts. ``first[d]`` to ``first[d + 1]`` are the words of text d."""

    data: np.ndarray
    offsets: np.ndarray  # of texts in data
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    sums: np.ndarray  # prefix sums of the polynomial over bytes, one longer than data

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        inverse = _powers(len(self.data) + 1)[1]
        return mix((self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def grid(texts: pa.Array, space: np.ndarray = SPACE) -> Grid:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        sums[1:] = data
        sums[1:] += np.uint64(1)
        sums[1:] *= _powers(len(data) + 1)[0][: len(data)]
        np.cumsum(sums[1:], out=sums[1:])
    return Grid(data, offsets, starts, ends, doc, first, sums)


def release() -> None:
    """Gives memory that is free back to the system."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and memory given back when its task ends: Spark keeps idle workers for a while."""

    @wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return held


def chunks(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row. Operators hold some hundred bytes for each byte of a range."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if len(size) > start:
        yield start, len(size)


def shingles(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` neighbouring words of one text, and the positions of their first words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[at + k])
    return out, at
