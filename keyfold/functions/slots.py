"""Hash slots of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CRC-16 polynomial (initial value 0) and the number of slots.
POLYNOMIAL = 0x1021
SLOTS = 16384


def _remainder(byte: int) -> int:
    """What a byte at the top of the register leaves after eight shifts."""
    r = byte << 8
    for _ in range(8):
        r = (r << 1) ^ (POLYNOMIAL if r & 0x8000 else 0)
    return r & 0xFFFF


def crc16(text: Column) -> Column:
    """CRC-16 of the text's UTF-8 bytes, a step a byte."""
    data = text.cast("binary")
    table = F.array(*[F.lit(_remainder(b)) for b in range(256)])

    def step(r: Column, i: Column) -> Column:
        b = F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("int")
        top = F.shiftright(r, 8).bitwiseXOR(b).bitwiseAND(F.lit(0xFF))
        return F.shiftleft(r, 8).bitwiseXOR(F.element_at(table, top + 1)).bitwiseAND(F.lit(0xFFFF))

    n = F.octet_length(data)
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step))


def hash_tag(key: Column) -> Column:
    """The part of a key that is hashed: within the first braces if not empty, else all."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag == "", key).otherwise(tag)


def key_slot(key: Column) -> Column:
    return crc16(hash_tag(key)).bitwiseAND(F.lit(SLOTS - 1))


def slot_owner(slot: Column, nodes: int) -> Column:
    """Node number of a slot under an equal split; the last node takes the remainder."""
    return F.least(F.floor(slot / (SLOTS // nodes)).cast("int"), F.lit(nodes - 1))
