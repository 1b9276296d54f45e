"""Vectorised text primitives over Arrow binary columns.

A batch of texts is one byte buffer with offsets. Words are found and hashed with prefix sums over
the buffer, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}

#: ASCII letters in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes once a text is in lower case: ASCII letters, digits, underscore, and all bytes of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n - 1."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for k, b in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x = x * U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins and ends."""
    large = pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `size` bytes; a longer text is a run of its own."""
    if not len(column):
        return
    data, off = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of a run of texts: byte positions `start` and `end`, and the text each is in; text i has words first[i] to first[i + 1]."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray):
        n = len(data)
        self.data, self.off = data, off
        ok = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[off[:-1]] = True
        before = np.concatenate(([False], ok[:-1])) if n else ok
        begins = ok & (~before | edge[:-1])
        after = np.concatenate((ok[1:], [False])) if n else ok
        ends = ok & (~after | edge[1:])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(off) - 1), self.count)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of other byte ranges."""
        s = self.start if start is None else start
        e = self.end if end is None else end
        return mix((self.sums[e] - self.sums[s]) * self.down[s])


def windows(h: np.ndarray, at: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of the windows of `width` words that begin at the words `at`."""
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h ^ U(salt)) * up[: len(h)] if salt else h * up[: len(h)], out=sums[1:])
    return mix((sums[at + width] - sums[at]) * down[at])


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """A binary column whose values are the rows of a contiguous matrix."""
    raw = np.ascontiguousarray(matrix).view(np.uint8).reshape(len(matrix), -1)
    off = np.arange(len(matrix) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def list_array(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def plus(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """`schema` with one more column."""
    return T.StructType([*schema.fields, T.StructField(name, kind)])
