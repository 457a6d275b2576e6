"""Hashes and packed keys of cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_U = np.uint64
# The constants of splitmix64 and of the Castagnoli polynomial.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
CASTAGNOLI = 0x82F63B78


def splitmix(state: np.ndarray) -> np.ndarray:
    """The output of splitmix64 for counters that the golden step has been added to."""
    x = (state ^ (state >> _U(30))) * _U(MIX_1)
    x = (x ^ (x >> _U(27))) * _U(MIX_2)
    return x ^ (x >> _U(31))


def nth_random(seed: int, n: np.ndarray) -> np.ndarray:
    """The n-th number, from 1, of the splitmix64 sequence of a seed."""
    with np.errstate(over="ignore"):
        return splitmix(_U(seed & (2**64 - 1)) + n.astype(_U) * _U(GOLDEN))


@F.pandas_udf(LongType())
def splitmix64(n: pd.Series) -> pd.Series:
    """Hash of a long, as the bits of a signed long."""
    with np.errstate(over="ignore"):
        return pd.Series(splitmix(n.to_numpy(np.int64).view(_U) + _U(GOLDEN)).view(np.int64))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(CASTAGNOLI), table >> np.uint32(1))
    return table


_TABLE = _crc_table()


def _after_zeros(n: int) -> np.ndarray:
    """What each bit of a register becomes after n zero bytes."""
    square = np.uint32(1) << np.arange(32, dtype=np.uint32)
    square = _TABLE[square & np.uint32(255)] ^ (square >> np.uint32(8))
    out = np.uint32(1) << np.arange(32, dtype=np.uint32)
    while n:
        if n & 1:
            out = _through(square, out)
        square, n = _through(square, square), n >> 1
    return out


def _through(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The registers x under the linear map that takes bit k to bits[k]."""
    return np.bitwise_xor.reduce(np.where((x[..., None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1), bits, np.uint32(0)), -1)


def _lanes(rows: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Registers after the bytes of each row, all rows side by side."""
    for byte in rows.T:
        state = _TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


def crc32c(data: bytes) -> int:
    """Long data is cut into lanes of equal length, which are run side by side and joined by
    what zeros in place of the later lanes would have made of the earlier ones."""
    raw = np.frombuffer(data, np.uint8)
    size = int(np.sqrt(len(raw)))
    state = np.full(1, 0xFFFFFFFF, np.uint32)
    if size >= 64:
        head = raw[: size * (len(raw) // size)].reshape(-1, size)
        start = np.zeros(len(head), np.uint32)
        start[0] = state[0]
        lanes, shift = _lanes(head, start), _after_zeros(size)
        state = lanes[:1]
        for lane in lanes[1:]:
            state = _through(shift, state) ^ lane
        raw = raw[head.size :]
    return int(_lanes(raw[None], state)[0]) ^ 0xFFFFFFFF


@F.pandas_udf(LongType())
def crc32c_of(data: pd.Series) -> pd.Series:
    """Checksum of byte strings; null for null.  Strings of one length run side by side."""
    out = pd.Series(pd.NA, index=data.index, dtype="Int64")
    held = data.dropna()
    for size, some in held.groupby(held.map(len)):
        rows = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), size)
        out[some.index] = (_lanes(rows, np.full(len(some), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    return out


def pack_cell(z: Column, y: Column, x: Column) -> Column:
    """Three coordinates in 21 bits each, plus 1, so that 0 is no cell."""
    low = lambda c: c.cast("long").bitwiseAND(F.lit((1 << 21) - 1))
    return F.shiftleft(low(z), 42).bitwiseOR(F.shiftleft(low(y), 21)).bitwiseOR(low(x)) + 1


def _signed(c: Column) -> Column:
    return F.when(c >= 1 << 20, c - (1 << 21)).otherwise(c)


def cell_page(*axes: Column) -> list[Column]:
    """What a packed cell leaves out of coordinates beyond 21 bits: 0 for all others."""
    return [c.cast("long") - _signed(c.cast("long").bitwiseAND(F.lit((1 << 21) - 1))) for c in axes]


def unpack_cell(key: Column, page: list[Column] | None = None) -> tuple[Column, Column, Column]:
    """Coordinates of a packed cell, negative ones too; beyond 21 bits with its page."""
    k = key - 1
    z, y, x = (_signed(F.shiftright(k, n).bitwiseAND(F.lit((1 << 21) - 1))) for n in (42, 21, 0))
    return (z, y, x) if page is None else (z + page[0], y + page[1], x + page[2])
