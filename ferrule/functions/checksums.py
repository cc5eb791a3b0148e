"""Cyclic checksums without byte loops, and their merging over pieces of a file.

A checksum from 0 is linear over GF(2): one zero byte more multiplies the state by a matrix, and the checksum of a + b is
that of a, moved on by len(b) zero bytes, xor that of b. So bytes are cut into lanes that are read side by side, and pieces
of a file that lie in different rows are merged by one bit_xor, in any order. The built-in crc32(), which inverts its
state before and after, merges by the same rule.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a lane, and of the part of a value that is read at once.
LANE, PART = 256, 4 << 20
#: Values shorter than this are read byte by byte, which is quicker there.
SHORT = 128
#: Sizes below 2 ** SIZE_BITS bytes can be merged.
SIZE_BITS = 48

#: Width, polynomial (bit-reversed if reflected) and whether it is reflected, of each checksum beside the built-in crc32().
CRCS = {"crc8": (8, 0x07, False), "crc16n": (16, 0x8005, False), "crc16r": (16, 0xA001, True), "crc32n0": (32, 0x04C11DB7, False)}
#: The built-in one, whose values merge as well.
MERGED = CRCS | {"crc32": (32, 0xEDB88320, True)}


def _bit_on(states: np.ndarray, width: int, poly: int, reflected: bool) -> np.ndarray:
    """States after one zero bit more."""
    one, mask = np.uint64(1), np.uint64((1 << width) - 1)
    if reflected:
        return np.where(states & one, states >> one ^ np.uint64(poly), states >> one)
    return np.where(states >> np.uint64(width - 1) & one, (states << one ^ np.uint64(poly)) & mask, states << one & mask)


def _bit_back(states: np.ndarray, width: int, poly: int, reflected: bool) -> np.ndarray:
    """States before the last zero bit; each polynomial here has its constant term, so there is exactly one."""
    one, top, mask = np.uint64(1), np.uint64(1 << (width - 1)), np.uint64((1 << width) - 1)
    if reflected:
        return np.where(states & top, (states ^ np.uint64(poly)) << one & mask | one, states << one & mask)
    return np.where(states & one, (states ^ np.uint64(poly)) >> one | top, states >> one)


def _times(matrix: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The xor of the matrix's columns at the bits that a state has set, for each state."""
    out = np.zeros_like(states)
    for i, column in enumerate(matrix):
        out ^= np.where(states >> np.uint64(i) & np.uint64(1), column, np.uint64(0))
    return out


@cache
def _table(spec: tuple[int, int, bool]) -> np.ndarray:
    """States after a byte, by the state's outgoing byte."""
    width, _, reflected = spec
    states = np.arange(256, dtype=np.uint64) << np.uint64(0 if reflected else width - 8)
    for _ in range(8):
        states = _bit_on(states, *spec)
    return states


@cache
def _moves(spec: tuple[int, int, bool], back: bool = False) -> list[np.ndarray]:
    """Matrices of 1, 2, 4, ... zero bytes more (or fewer), as images of single bits."""
    matrix = np.uint64(1) << np.arange(spec[0], dtype=np.uint64)
    for _ in range(8):
        matrix = (_bit_back if back else _bit_on)(matrix, *spec)
    out = [matrix]
    while len(out) < SIZE_BITS:
        out.append(_times(out[-1], out[-1]))
    return out


def _moved(states: np.ndarray, zeros: np.ndarray, spec: tuple[int, int, bool]) -> np.ndarray:
    """States after so many zero bytes more."""
    for k in range(int(zeros.max(initial=0)).bit_length()):
        on = np.flatnonzero(zeros >> k & 1)
        states[on] = _times(_moves(spec)[k], states[on])
    return states


def _lanes(values: list[bytes], spec: tuple[int, int, bool]) -> np.ndarray:
    """Checksums of values that are not empty, read side by side; zero bytes before a value change nothing."""
    width, _, reflected = spec
    counts = np.array([-(-len(v) // LANE) for v in values])
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    held = np.frombuffer(b"".join(bytes(-len(v) % LANE) + v for v in values), np.uint8).reshape(-1, LANE)
    states, table, mask, shift = np.zeros(len(held), np.uint64), _table(spec), np.uint64((1 << width) - 1), np.uint64(width - 8)
    for column in np.ascontiguousarray(held.T):
        if reflected:
            states = states >> np.uint64(8) ^ table[(states ^ column) & np.uint64(255)]
        else:
            states = (states << np.uint64(8) ^ table[states >> shift ^ column]) & mask
    after = np.repeat(firsts + counts, counts) - np.arange(len(held)) - 1
    return np.bitwise_xor.reduceat(_moved(states, after * LANE, spec), firsts)


def crc(data: bytes, width: int, poly: int, reflected: bool) -> int:
    """Remainder of data, initial value 0 and no final inversion."""
    spec, out = (width, poly, reflected), 0
    if len(data) < SHORT:
        table, mask = _table(spec), (1 << width) - 1
        for b in data:
            out = out >> 8 ^ int(table[(out ^ b) & 255]) if reflected else (out << 8 ^ int(table[out >> width - 8 ^ b])) & mask
        return out
    for at in range(0, len(data), PART):
        part = data[at : at + PART]
        out = int(_moved(np.array([out], np.uint64), np.array([len(part)]), spec)[0] ^ _lanes([part], spec)[0])
    return out


def crcs(values: list[bytes | None], kind: str) -> list[int | None]:
    """Checksums of a batch: values of at most PART bytes together, longer ones by their parts; None of None, 0 of empty."""
    spec = CRCS[kind]
    out: list[int | None] = [None if v is None else 0 for v in values]
    group: list[int] = []
    held = 0
    for i, v in enumerate(values):
        if not v:
            continue
        if len(v) > PART:
            out[i] = crc(v, *spec)
            continue
        if held + len(v) > PART:
            for j, got in zip(group, _lanes([values[j] for j in group], spec), strict=True):
                out[j] = int(got)
            group, held = [], 0
        group.append(i)
        held += len(v)
    if group:
        for j, got in zip(group, _lanes([values[j] for j in group], spec), strict=True):
            out[j] = int(got)
    return out


def crc_column(kind: str, data: Column) -> Column:
    """A checksum of a binary column; null of null."""

    @F.pandas_udf("long")
    def compute(values: pd.Series) -> pd.Series:
        return pd.Series(crcs(values.tolist(), kind), dtype="Int64")

    return compute(data)


def moved(kind: str, state: Column, zeros: Column, back: bool = False) -> Column:
    """A checksum after zeros (a long below 2 ** SIZE_BITS) zero bytes more, or fewer; null of null."""
    rows = (",".join(f"{x}L" for x in matrix) for matrix in _moves(MERGED[kind], back))
    matrices = F.expr(f"array({','.join(f'array({row})' for row in rows)})")
    bit = lambda value, i: F.call_function("shiftright", value, i).bitwiseAND(F.lit(1).cast("long"))

    def step(told: Column, k: Column) -> Column:
        images = F.zip_with(F.get(matrices, k), F.sequence(F.lit(0), F.lit(MERGED[kind][0] - 1)), lambda image, i: image * bit(told, i))
        return F.when(bit(zeros, k) == 1, F.aggregate(images, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))).otherwise(told)

    known = state.isNotNull() & zeros.isNotNull()
    return F.when(known, F.aggregate(F.sequence(F.lit(0), F.length(F.bin(zeros)) - 1), state.cast("long"), step))


def merged(pieces: DataFrame, kind: str, *keys: str, pos: str = "pos", size: str = "size", state: str = "crc") -> DataFrame:
    """keys, size, n_missing and crc of files whose pieces (keys, pos, size, crc) do not overlap, in any order.

    Each piece is moved back by its end, so that all meet at place 0 whatever the file's size, which only the aggregate
    knows; the sum is moved on by that size. One aggregation, with partial sums before the shuffle. Bytes that no piece has
    are counted in n_missing, and crc is null there, as it is where a piece's own is null. Empty pieces change nothing.
    """
    end = F.col(pos) + F.col(size)
    out = pieces.groupBy(*keys).agg(
        F.max(end).alias("_end"), F.sum(size).alias("_held"), F.count_if(F.col(state).isNull()).alias("_null"),
        F.bit_xor(moved(kind, F.col(state), end, back=True)).alias("_sum"),
    )
    whole = (F.col("_held") == F.col("_end")) & (F.col("_null") == 0)
    return out.select(*keys, F.col("_end").alias("size"), (F.col("_end") - F.col("_held")).alias("n_missing"), F.when(whole, moved(kind, F.col("_sum"), F.col("_end"))).alias("crc"))
