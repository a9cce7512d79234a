"""Fixed-width integers in BINARY columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_be(value: Column, width: int) -> Column:
    """A non-negative integer as ``width`` big-endian bytes; null if it does not fit."""
    text = F.hex(value.cast("long"))
    return F.when((value >= 0) & (F.length(text) <= 2 * width), F.unhex(F.lpad(text, 2 * width, "0")))


def from_be(data: Column) -> Column:
    """Unsigned big-endian integer of up to 8 bytes as DECIMAL(20,0)."""
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def to_le32(value: Column) -> Column:
    """A signed 32-bit integer as 4 little-endian bytes (-1 is ff ff ff ff)."""
    text = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 32))), 8, "0")
    return F.unhex(F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)]))


def from_le32(data: Column) -> Column:
    text = F.hex(data)
    big = F.conv(F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.when(big >= (1 << 31), big - (1 << 32)).otherwise(big).cast("int")


def bulk(value: Column) -> Column:
    """RESP bulk string of a text; null becomes the null bulk."""
    return F.when(value.isNull(), F.lit("$-1\r\n")).otherwise(F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit("\r\n"), value, F.lit("\r\n")))


def resp_array(args: Column) -> Column:
    """RESP array of bulk strings from an ARRAY<STRING>."""
    return F.concat(F.lit("*"), F.size(args).cast("string"), F.lit("\r\n"), F.array_join(F.transform(args, bulk), ""))
