"""Vectorised word kernels over Arrow string columns.

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Whole Arrow batches are
turned into word tables (byte ranges, 64-bit hashes, owning row) with numpy alone, so the
Python workers never loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text that one kernel call works on; one longer document is a call of its own.
SLICE_BYTES = 1 << 20

BYTE_STEP = U64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed eight at a time; the rest of a longer one goes in at once.
LONG = 256
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
WORD_STEP = 0xD6E8FEB86659FD93 | 1
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, step: int) -> None:
        self.step, self.inverse = step, pow(step, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.step), ("down", self.inverse)):
                x = np.full(size, base, U64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U64))
        return self.up[:n], self.down[:n]


_words = _Powers(WORD_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the bytes of every range: eight bytes at a time, mixed after each step, so
    that equal lengths of up to eight bytes never collide."""
    size = end - start
    out = mix(size.astype(U64) + (U64(salt) << U64(48)))
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    which, at, left = np.arange(len(start)), start, size
    for step in range(0, LONG, 8):
        if step:
            go = left > 8
            which, at, left = which[go], at[go] + 8, left[go] - 8
        if not len(which):
            return out
        out[which] = mix(out[which] ^ ((eight[at] & _TAIL[np.minimum(left, 8)]) * BYTE_STEP))
    raw = memoryview(data)
    for i in which[left > 8].tolist():
        out[i : i + 1] = mix(out[i : i + 1] ^ U64(xxhash.xxh3_64_intdigest(raw[start[i] + LONG : end[i]])))
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    pa.default_memory_pool().release_unused()  # what the batch before took
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes; one row alone may be longer."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of some texts: byte range, row and place in the row of each, and its hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, is_word: np.ndarray = IS_WORD) -> None:
        inside = is_word[data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        if n:
            before[off[:-1][off[:-1] < n]] = False
            after[off[1:][off[1:] > 0] - 1] = False
        self.data, self.rows = data, len(off) - 1
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.place = np.arange(len(self.start)) - self.first[self.row]

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.start, self.end)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes, across texts too."""
    if len(words) < n:
        return np.zeros(0, U64)
    up, down = _words.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1] + U64(n))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values, by doubling."""
    if len(x) < n:
        return x[:0]
    width, out = 1, x
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... count[i] values each, one after another."""
    out = np.arange(int(count.sum()))
    return out + np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
