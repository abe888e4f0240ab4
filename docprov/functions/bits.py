"""Columns over 64-bit hashes and 48-bit payloads (36 bits of id, 8 of CRC, 4 of version)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD_BITS, ID_BITS = 48, 36


def crc8_of(value: int, bits: int = 40) -> int:
    """CRC-8, polynomial 0x07, start 0, highest bit first."""
    crc = 0
    for k in reversed(range(bits)):
        crc = ((crc << 1) & 0xFF) ^ (0x07 if (crc >> 7) ^ (value >> k & 1) else 0)
    return crc


def id_crc(value: int) -> int:
    """Of a 36-bit id, padded with zeros on the right to whole bytes."""
    return crc8_of(value << 4)


def crc8(short_id: Column) -> Column:
    """id_crc as a column. The CRC is linear: each of its bits is the parity of some of the id's bits."""
    out = F.lit(0).cast("bigint")
    for k in range(8):
        mask = sum(1 << i for i in range(ID_BITS) if id_crc(1 << i) >> k & 1)
        out = out.bitwiseOR(F.shiftleft((F.bit_count(short_id.bitwiseAND(F.lit(mask))) % 2).cast("bigint"), k))
    return out


def flip_masks() -> list[int]:
    """For each syndrome the first flip that explains it, as a mask over id and CRC (44 bits); 0 if there is none.

    First one bit of the 44 from the left, then two bits of the id in order.
    """
    effect = [id_crc(1 << (35 - i)) for i in range(36)] + [1 << (7 - i) for i in range(8)]
    masks = [0] * 256
    flips = [(i,) for i in range(44)] + [(i, j) for i in range(36) for j in range(i + 1, 36)]
    for flip in flips:
        syndrome = 0
        for i in flip:
            syndrome ^= effect[i]
        if syndrome and not masks[syndrome]:
            masks[syndrome] = sum(1 << (43 - i) for i in flip)
    return masks


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def short_id(receipt_hex: Column) -> Column:
    return F.conv(F.substring(F.regexp_replace(receipt_hex, "^0x", ""), 1, 9), 16, 10).cast("bigint")


def build_payload(short: Column, version: int = 1) -> Column:
    return F.shiftleft(short, 12).bitwiseOR(F.shiftleft(crc8(short), 4)).bitwiseOR(F.lit(version & 15))


def payload_id(payload: Column) -> Column:
    return F.shiftright(payload, 12)


def payload_crc(payload: Column) -> Column:
    return F.shiftright(payload, 4).bitwiseAND(F.lit(255))


def degenerate(payload: Column) -> Column:
    ones, own = F.bit_count(payload), payload_id(payload)
    return (ones <= 6) | (ones >= 42) | own.isin(0, (1 << ID_BITS) - 1)


def crc_ok(payload: Column) -> Column:
    return (crc8(payload_id(payload)) == payload_crc(payload)) & ~degenerate(payload)


def payload_of(bits: Column) -> Column:
    """The number that 48 characters 0 and 1 say; null for anything else."""
    return F.when(bits.rlike("^[01]{48}$"), F.conv(bits, 2, 10).cast("bigint"))


def bit_string(payload: Column) -> Column:
    return F.lpad(F.bin(payload), PAYLOAD_BITS, "0")


def repaired(payload: Column) -> Column:
    """payload with the flip that explains its CRC, if there is one."""
    syndrome = crc8(payload_id(payload)).bitwiseXOR(payload_crc(payload)).cast("int")
    masks = F.array(*(F.lit(m).cast("bigint") for m in flip_masks()))
    return payload.bitwiseXOR(F.shiftleft(masks[syndrome], 4))


def matching(a: Column, b: Column) -> Column:
    return F.lit(PAYLOAD_BITS) - hamming(a, b)


def signed64(hex16: Column) -> Column:
    return F.conv(hex16, 16, -10).cast("bigint")


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves upwards, on doubles."""
    return F.floor(x * 10**places + 0.5) / 10**places
