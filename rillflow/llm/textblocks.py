"""Vectorised text handling over Arrow string columns.

A batch of texts is one byte buffer plus row offsets.  Words, word hashes,
hashes of word or byte windows and winnowed anchors of a whole block of rows
are computed with a few NumPy passes, never with a Python loop over words.
Blocks are cut to half a megabyte, so memory does not follow the batch size;
a single text longer than a block forms a block of its own.

Null texts count as empty.  Hashes are 64 bit; callers that need certainty
carry two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (xor-shift-multiply rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Roller:
    """Polynomial hashes of arbitrary ranges by prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            m = max(n, 2 * len(self._up), 1 << 16)
            self._up = _geometric(self.base, m)
            self._down = _geometric(self.inverse, m)
        return self._up, self._down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of values[lo:hi], independent of where the range lies."""
        _, down = self.powers(len(prefix))
        return (prefix[hi] - prefix[lo]) * down[lo]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


_BYTES = Roller(0x9E3779B97F4A7C15)
_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_WORDS = (Roller(0xC2B2AE3D27D4EB4F), Roller(0xA0761D6478BD642F))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Block:
    """Some consecutive rows of a batch: `first` is the row number of the first."""

    def __init__(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: int):
        self.buf, self.lo, self.hi, self.first = buf, lo, hi, first
        self.n = len(lo)

    def words(self, separators: np.ndarray | None = None) -> Words:
        return Words(self, SPACE if separators is None else separators)

    def text(self, row: int) -> bytes:
        return self.buf[self.lo[row] : self.hi[row]].tobytes()


class Words:
    """Words (maximal runs of bytes that are no separators) of a block, in row order."""

    def __init__(self, block: Block, separators: np.ndarray):
        self.block = block
        inside = ~separators[block.buf]
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        full = block.hi > block.lo
        a, b = block.lo[full], block.hi[full] - 1
        start[a] = inside[a]
        stop[b] = inside[b]
        self.lo = np.flatnonzero(start)
        self.hi = np.flatnonzero(stop) + 1
        self.row_lo = np.searchsorted(self.lo, block.lo)
        self.row_hi = np.searchsorted(self.lo, block.hi)
        self.n = len(self.lo)

    def hashes(self) -> np.ndarray:
        prefix = _BYTES.prefix(_SYMBOLS[self.block.buf])
        return mix64(_BYTES.ranges(prefix, self.lo, self.hi) + _U(0x632BE59BD9B4E019))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.block.n), self.row_hi - self.row_lo)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of about `size` bytes, whole rows each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, buffers = len(column), column.buffers()
    if not n:
        return
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        base = offsets[at]
        yield Block(data[base : offsets[to]], offsets[at:to] - base, offsets[at + 1 : to + 1] - base, at)
        at = to


def window_hashes(values: np.ndarray, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of values[s:s+length] for every s in starts."""
    roll = _WORDS[which]
    prefix = roll.prefix(values if which == 0 else values ^ _U(0x5851F42D4C957F2D))
    return mix64(roll.ranges(prefix, starts, starts + length))


def gram_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of values[i:i+length] for every i."""
    prefix = _WORDS[0].prefix(values)
    out = prefix[length:] - prefix[:-length]
    out *= _WORDS[0].powers(len(out))[1][: len(out)]
    return mix64(out)


def range_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    roll = _WORDS[which]
    prefix = roll.prefix(values if which == 0 else values ^ _U(0x5851F42D4C957F2D))
    return mix64(roll.ranges(prefix, lo, hi) + (hi - lo).astype(np.uint64))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the minimum of h[i:i+width], for every full window i; the rightmost of equals.

    The low 31 bits of each hash make room for its index, so plain minima carry it along.  What is left of the hash
    does not depend on the block, and neither does the choice among equals: equal windows choose the same place."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _U((1 << 31) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)[::-1]
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return (len(h) - 1) - (best[:n] & low).astype(np.int64)


class Anchors:
    """Winnowed anchors: every window of `length` units selects one `gram`.

    Windows with equal content select the gram at the same offset, so two equal
    windows always meet at equal anchors.  Windows that select one anchor start
    in lo..hi (inclusive)."""

    def __init__(self, values: np.ndarray, row_lo: np.ndarray, row_hi: np.ndarray, length: int, gram: int):
        n = len(values)
        if n < length:
            self.at = self.lo = self.hi = self.row = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        grams = gram_hashes(values, gram)
        pick = window_minima(grams, length - gram + 1)
        sizes = row_hi - row_lo
        row = np.repeat(np.arange(len(row_lo)), sizes)
        for_row = np.maximum(sizes - length + 1, 0)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, row_lo[for_row > 0], 1)
        np.add.at(edge, (row_lo + for_row)[for_row > 0], -1)
        ok = np.cumsum(edge[:-1]) > 0
        start = np.flatnonzero(ok[: len(pick)])
        pick, r = pick[start], row[start]
        new = np.ones(len(start), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        self.lo, self.hi, self.at, self.row = start[first], start[last], pick[first], r[first]
        self.key = grams[self.at]
