"""Byte positions and bits of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(start: Column, stop: Column, size: Column) -> tuple[Column, Column]:
    """Inclusive bounds with negatives from the end, kept inside [0, size)."""
    lo = F.greatest(F.when(start < 0, start + size).otherwise(start), F.lit(0))
    hi = F.least(F.when(stop < 0, stop + size).otherwise(stop), size - 1)
    return lo, hi


def byte_range(value: Column, start: int, stop: int) -> Column:
    """Bytes start..stop (inclusive, negatives from the end) as binary; empty if none."""
    b = value.cast("binary")
    lo, hi = clamp(F.lit(start), F.lit(stop), F.octet_length(b))
    return F.when(lo > hi, F.lit(b"")).otherwise(F.substr(b, lo + 1, hi - lo + 1))


def byte_at(value: Column, i: Column) -> Column:
    """The byte at position i from 0, as a number."""
    return F.conv(F.hex(F.substr(value, i + 1, F.lit(1))), 16, 10).cast("int")


def bit_count(value: Column) -> Column:
    """Set bits of a binary."""
    n = F.octet_length(value)
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda a, i: a + F.bit_count(byte_at(value, i)))
    )


def bit_at(value: Column, offset: Column) -> Column:
    """Bit at an offset, the first byte's highest bit being 0; 0 beyond the end."""
    i = F.floor(offset / 8).cast("int")
    inside = F.call_function("shiftright", byte_at(value, i), (7 - offset % 8).cast("int")).bitwiseAND(F.lit(1))
    return F.when(i < F.octet_length(value), inside).otherwise(F.lit(0))


def bit_position(value: Column, bit: int, start: int = 0, stop: int = -1) -> Column:
    """First offset of ``bit`` in a range of bytes; for 0 in all ones the first after it; else -1."""
    lo, hi = clamp(F.lit(start), F.lit(stop), F.octet_length(value))
    found = F.array_min(F.filter(F.sequence(lo * 8, hi * 8 + 7), lambda i: bit_at(value, i) == bit))
    missing = (hi + 1) * 8 if bit == 0 else F.lit(-1)
    return F.when(lo > hi, F.lit(-1)).otherwise(F.coalesce(found, missing)).cast("long")
