"""Words and word hashes of whole texts, taken straight from Arrow's UTF-8 buffers.

A batch is cut into chunks of whole texts of about ``CHUNK_BYTES``, so that the numpy arrays of a
task stay small however large its rows are; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_FIRST = U64(0x9E3779B97F4A7C15)
_SECOND = U64(0xBF58476D1CE4E5B9)
_THIRD = U64(0x94D049BB133111EB)
_STEP = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64

#: Bytes that are part of a word.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x + _FIRST
    x = (x ^ (x >> U64(30))) * _SECOND
    x = (x ^ (x >> U64(27))) * _THIRD
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64))


class _Powers:
    """Powers of the step and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def __reduce__(self):
        return (_Powers, ())  # the tables are built anew where they are needed

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK_BYTES)
            for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                steps = np.full(size, U64(base))
                steps[0] = U64(1)
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


@dataclass
class Words:
    """The words of some consecutive texts.

    ``starts`` and ``ends`` are byte places in ``data``; ``first[i]:first[i + 1]`` are the words of text i.
    """

    data: np.ndarray
    rows: range
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        if not len(self.starts):
            return np.zeros(0, U64)
        up, down = _powers.upto(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) for runs of whole texts."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        last = int(np.searchsorted(at, at[row] + chunk_bytes, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield range(row, last), data[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def words(column: pa.Array, inside: np.ndarray, fold: np.ndarray = SAME) -> Iterator[Words]:
    """The words of every text: maximal runs of the bytes of ``inside`` after ``fold``."""
    for rows, raw, bounds in chunks(column):
        data = raw if fold is SAME else fold[raw]
        word = inside[data]
        edge = np.empty(len(data) + 1, bool)
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, word
        edge[:-1], edge[-1] = word, False
        starts, ends = edge & ~before, before & ~edge
        # a word never runs over the border of two texts
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        touching = np.unique(inner[word[inner] & word[inner - 1]]) if len(inner) else inner
        starts[touching] = True
        ends[touching] = True
        s, e = np.flatnonzero(starts), np.flatnonzero(ends)
        yield Words(data, rows, bounds, s, e, np.searchsorted(s, bounds))


def windows(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """64 bits for each run of k consecutive hashes (empty when there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _powers.upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(mix(hashes ^ U64(seed)) * up[: len(hashes)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
