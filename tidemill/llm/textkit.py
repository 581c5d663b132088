"""Vectorised words, word hashes and rolling window hashes over Arrow string columns.

Word hashes are mixed polynomials over bytes modulo 2**64, from differences of running sums over segments of bounded
size; long words take BLAKE2b. A window's hash is a polynomial over its words' hashes, put together from windows of half
the size, so that it costs a few passes and no tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words above this many bytes are hashed by BLAKE2b.
LONG_WORD = 256
#: Bytes that are hashed at a time: what a worker holds for it is a few dozen times as much.
SEGMENT = 1 << 18
#: Bytes of text that are worked on at a time; one longer text is worked on by itself.
SLICE = 1 << 20
U = np.uint64
#: Odd bases of the two polynomials over words, and of the two over bytes that they are built on.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BYTE_BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for every place in a segment, kept for the next call."""
    if base not in _powers:
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(SEGMENT + LONG_WORD, x, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finisher)."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """The words of a string column. data: all bytes; start, end: of each word; first: index of each row's first word,
    and at the end the number of words."""

    def __init__(self, col, lower: bool = False):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        col = pc.fill_null(col.cast(pa.large_string()), "")
        buffers = col.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]] if len(offsets) else data
        self.offsets = offsets = offsets - offsets[0]
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        gap = SPACE[data]
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = gap[:-1]
        edge[offsets] = True
        self.start = np.flatnonzero(edge[:n] & ~gap)
        edge[1:n] = gap[1:]
        edge[offsets] = True
        self.end = np.flatnonzero(edge[1:] & ~gap) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        """A hash of each word; both values of ``which`` are independent."""
        size = self.end - self.start
        out, at = np.empty(len(self), dtype=U), 0
        short = np.flatnonzero(size <= LONG_WORD)
        start, end = self.start[short], self.end[short]
        p, inverse = powers(BYTE_BASES[which])
        while at < len(short):
            lo = int(start[at])
            to = int(np.searchsorted(end, lo + SEGMENT + LONG_WORD, side="right"))
            hi = int(end[to - 1])
            sums = np.zeros(hi - lo + 1, dtype=U)
            part = self.data[lo:hi].astype(U)
            part += U(1)
            part *= p[: hi - lo]
            np.cumsum(part, out=sums[1:])
            s, e = start[at:to] - lo, end[at:to] - lo
            out[short[at:to]] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) * U(0xA0761D6478BD642F))
            at = to
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].data, digest_size=8, salt=bytes([which])).digest(), "little")
        return out


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of k words, by their first word; runs may cross rows."""
    base = BASES[which]
    if len(h) < k:
        return np.zeros(0, U)
    part, m, out, have = h, 1, None, 0
    while True:  # part: of m words, a power of two; out: of the first `have` words, by the binary digits of k
        step = U(pow(base, m, 1 << 64))
        if k & m:
            out, have = (part, m) if out is None else (out[: len(h) - have - m + 1] * step + part[have:], have + m)
        if have == k:
            return mix(out)
        part, m = part[:-m] * step + part[m:], 2 * m


def sequences(h: np.ndarray, first: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each row's whole word sequence."""
    n = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h ^ mix(place.astype(U) * U(BASES[which]))), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + n.astype(U))


def slices(batch, column: str, size: int = SLICE):
    """batch in pieces of about so many bytes of a string column; one long text is a piece of its own."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.concatenate([[0], np.cumsum(n)]), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: item i is the bytes of values[bounds[i]:bounds[i + 1]]."""
    offsets = (bounds * values.dtype.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(col, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and the row that each is from."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    size = np.dtype(dtype).itemsize
    values = np.frombuffer(raw[int(offsets[0]) : int(offsets[-1])] if raw else b"", dtype=dtype)
    return values, np.repeat(np.arange(len(col)), np.diff(offsets) // size)
