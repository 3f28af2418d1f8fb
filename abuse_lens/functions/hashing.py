"""FNV-1a as Catalyst expressions.

The 64-bit FNV prime is 2^40 + 435.  Modulo 2^32 only the 435 is left, so the
low half of the hash can be followed alone in a bigint that never overflows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a with 64 bits.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
FNV_PRIME_LOW = 435
LOW_32 = 0xFFFFFFFF


def parse_salt(text: str) -> bytes:
    """Salt text of exactly 16 hex digits to its 8 bytes."""
    if not re.fullmatch(r"[0-9a-fA-F]{16}", text):
        raise ValueError(f"salt must be 16 hex digits, got {text!r}")
    return bytes.fromhex(text)


def fnv1a64(data: bytes) -> int:
    """Full hash of a driver-side constant (a salt or an incident tag)."""
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def hash_ipv4(ip: Column, salt: str) -> Column:
    """Pseudonym of an address: low 32 bits of the hash of salt then address.

    The salt is constant, so its eight steps are folded on the driver and only
    the four address bytes remain in the expression.
    """
    h: Column = F.lit(fnv1a64(parse_salt(salt)) & LOW_32).cast("bigint")
    for shift in (24, 16, 8, 0):
        byte = F.shiftright(ip, shift).bitwiseAND(F.lit(255))
        h = (h.bitwiseXOR(byte) * FNV_PRIME_LOW).bitwiseAND(F.lit(LOW_32))
    return h


def tag_fingerprint(tag: Column) -> Column:
    """Full hash of a text column as 16 hex digits, one step per UTF-8 byte.

    The two halves are kept in bigints: times 2^40 only shifts the low half up
    by 8 inside the high half, times 435 carries from the low half to the high.
    """
    data = F.encode(tag, "UTF-8")
    positions = F.filter(F.sequence(F.lit(0), F.length(data)), lambda i: i > 0)
    codes = F.transform(positions, lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("bigint"))
    half = lambda c: c.bitwiseAND(F.lit(LOW_32).cast("bigint"))
    pair = lambda hi, lo: F.struct(hi.alias("hi"), lo.alias("lo"))

    def step(h: Column, byte: Column) -> Column:
        lo = h["lo"].bitwiseXOR(byte)
        product = lo * FNV_PRIME_LOW
        carry = F.shiftright(product, 32)
        return pair(half(h["hi"] * FNV_PRIME_LOW + carry + lo * 256), half(product))

    start = pair(F.lit(FNV_OFFSET >> 32).cast("bigint"), F.lit(FNV_OFFSET & LOW_32).cast("bigint"))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    return F.aggregate(codes, start, step, lambda h: F.concat(digits(h["hi"]), digits(h["lo"])))
