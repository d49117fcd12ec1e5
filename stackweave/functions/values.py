"""Stored scalar values: their tags, bytes and order; sequences, maps and blobs of them; digests."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The tags of scalar kinds, by position, and the bytes of the integers among them.
KINDS = ("null", "bool", "i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64", "f32", "f64", "utf8", "binary", "date32", "date64", "time32", "time64", "timestamp", "duration", "decimal128", "decimal256")
WIDTHS = {"i8": 1, "i16": 2, "i32": 4, "i64": 8, "u8": 1, "u16": 2, "u32": 4, "date32": 4, "date64": 8}


def tag(kind: str) -> int:
    return KINDS.index(kind)


def _little_endian(value: Column, width: int) -> Column:
    """The lowest ``width`` bytes of a number, least first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)]))


def order_key(value: Column, kind: str) -> Column:
    """The bytes that stored values are ordered by: the tag, then text as it is and numbers least byte first.

    So the order of integers is not their numeric order: 256 comes before 1.
    """
    head = F.unhex(F.lit(f"{tag(kind):02X}"))
    if kind == "null":
        return head
    if kind == "bool":
        return F.concat(head, F.when(value, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))))
    if kind in WIDTHS:
        return F.concat(head, _little_endian(value, WIDTHS[kind]))
    if kind in ("utf8", "binary"):
        return F.concat(head, F.encode(value, "UTF-8") if kind == "utf8" else value)
    raise ValueError(f"{kind} has no order key here")


def concat_sequences(*parts: Column) -> Column:
    return F.concat(*parts)


def union_maps(*parts: Column) -> Column:
    """Maps as one; a key that two of them have is an error."""
    return F.map_concat(*parts)


def concat_blobs(*parts: Column) -> Column:
    return F.concat(*parts)


def fold_sequences(parts: list[Column]) -> Column:
    """The sum of all values of sequences, as a sequence of one."""
    return F.array(F.aggregate(F.concat(*parts), F.lit(0).cast("bigint"), lambda a, x: a + x))


def hex16(value: Column) -> Column:
    """16 bytes as 32 lower-case digits; null for any other length."""
    return F.when(F.octet_length(value) == 16, F.lower(F.hex(value)))


def unhex16(text: Column) -> Column:
    return F.when(text.rlike("^[0-9a-f]{32}$"), F.unhex(text))


def canonical_digest(name: bytes, parts: list[bytes]) -> bytes:
    """XXH3-128 over a tag and parts, each after its length in 8 bytes, least first."""
    framed = b"".join(len(p).to_bytes(8, "little") + p for p in [name, *parts])
    return xxhash.xxh3_128_digest(framed)


def digest_of(name: str, payload: Column) -> Column:
    """The canonical digest of one part, for a column of bytes."""

    @F.pandas_udf(BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else canonical_digest(name.encode(), [bytes(v)]))

    return run(payload)
