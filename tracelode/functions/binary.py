"""Reading numbers, addresses and text out of BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uint(data: Column, offset: Column | int, width: int) -> Column:
    """Big-endian unsigned integer of ``width`` bytes at 0-based ``offset``."""
    start = (offset + F.lit(1)) if isinstance(offset, Column) else F.lit(offset + 1)
    return F.conv(F.hex(F.substring(data, start, F.lit(width))), 16, 10).cast("bigint")


def u8(data: Column, offset: Column | int) -> Column:
    return uint(data, offset, 1)


def u16(data: Column, offset: Column | int) -> Column:
    return uint(data, offset, 2)


def u32(data: Column, offset: Column | int) -> Column:
    return uint(data, offset, 4)


def ipv4_at(data: Column, offset: Column | int) -> Column:
    """Dotted address from the four bytes at ``offset``."""
    return F.concat_ws(".", *[u8(data, offset + i).cast("string") for i in range(4)])


def hex_prefix(data: Column, n: int) -> Column:
    """Lower-case hex of the first ``n`` bytes."""
    return F.lower(F.hex(F.substring(data, 1, n)))


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def latin1(data: Column) -> Column:
    """Text view with one character per byte, so positions count bytes."""
    return F.decode(data, "ISO-8859-1")


def be_hex(value: Column, width: int) -> Column:
    """Hex text of a non-negative integer as ``width`` big-endian bytes; of a larger one, its low bytes."""
    digits = F.concat(F.lit("0" * (2 * width)), F.hex(value.cast("bigint")))
    return F.substring(digits, -2 * width, 2 * width)
