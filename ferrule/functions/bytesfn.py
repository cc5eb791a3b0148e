"""Columns over bytes and numbers: hex, endian integers, bit fields, checksums and variable-length integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.checksums import CRCS, crc, crc_column  # noqa: F401 - offered here as well


def be_uint(data: Column, at: int | Column, size: int) -> Column:
    """Unsigned big-endian integer of size bytes at a 0-based place, as a long; null beyond the end."""
    part = F.substring(data, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def le_uint(data: Column, at: int | Column, size: int) -> Column:
    """Unsigned little-endian integer of size bytes."""
    start = F.lit(at) if isinstance(at, int) else at
    bytes_ = [be_uint(data, start + i, 1) for i in range(size)]
    out = bytes_[0]
    for i, b in enumerate(bytes_[1:], 1):
        out = out + b * (1 << 8 * i)
    return out


def signed(value: Column, bits: int) -> Column:
    """The two's complement reading of an unsigned integer."""
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def bit_field(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def syncsafe(value: Column) -> Column:
    """28 bits spread over four bytes of seven; null if a top bit is set."""
    bad = value.bitwiseAND(F.lit(0x80808080).cast("long")) != 0
    parts = [F.shiftright(value.bitwiseAND(F.lit(0x7F << 8 * i).cast("long")), i) for i in range(4)]
    return F.when(~bad, parts[0] + parts[1] + parts[2] + parts[3])


def bit_string(value: Column, width: int) -> Column:
    """Bits in groups of four, counted from the right."""
    bits = F.reverse(F.lpad(F.bin(value), width, "0"))
    return F.reverse(F.rtrim(F.regexp_replace(bits, "(.{4})", "$1 ")))


def ascii_prefix(text: Column) -> Column:
    """The printable ASCII characters at the start."""
    return F.regexp_extract(text, "^[ -~]*", 0)


def leading_int(text: Column) -> Column:
    """The digits after leading blanks; 0 if there are none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([0-9]*)", 1).try_cast("long"), F.lit(0).cast("long"))


def table_lookup(index: Column, values: list) -> Column:
    """values[index], with a 0-based index; null beyond it."""
    return F.get(F.array(*(F.lit(v) for v in values)), index)


def read_varint(data: bytes, at: int = 0) -> tuple[int | None, int]:
    """(value, bytes) of an extended UTF-8 number of up to 36 bits; value None if the bytes are no such number."""
    if at >= len(data):
        return None, 0
    first = data[at]
    if first < 0x80:
        return first, 1
    size = 8 - (first ^ 0xFF).bit_length()
    if size < 2 or size > 7 or at + size > len(data):
        return None, 1
    value = first & ((1 << (7 - size)) - 1)
    for b in data[at + 1 : at + size]:
        if b & 0xC0 != 0x80:
            return None, 1
        value = value << 6 | b & 0x3F
    return value, size


def read_vint(data: bytes, at: int = 0, marker: bool = False) -> tuple[int | None, int]:
    """(value, bytes) of an EBML number of one to eight bytes; marker keeps the length bit, as ids have it."""
    if at >= len(data) or data[at] == 0:
        return None, 0
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        return None, 0
    value = int.from_bytes(data[at : at + size], "big")
    return (value if marker else value & ((1 << 7 * size) - 1)), size
