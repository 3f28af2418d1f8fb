"""IPv4 helpers as Column expressions (bigint addresses, first octet highest)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from abuse_lens.schema import U32_MAX

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DOTTED_QUAD = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_to_long(text: Column) -> Column:
    """Dotted quad to bigint; null when the text is not a strict dotted quad."""
    octets = F.transform(F.split(text, r"\."), lambda o: o.cast("bigint"))
    packed = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(text.rlike(DOTTED_QUAD), packed)


def long_to_ipv4(ip: Column) -> Column:
    octet = lambda shift: F.shiftright(ip, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.when(ip.isNotNull(), F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)))


def mask_of(prefix_len: int) -> int:
    return (U32_MAX << (32 - prefix_len)) & U32_MAX if prefix_len else 0


def cidr_mask(prefix_len: Column) -> Column:
    """Mask for a prefix-length column; a /0 masks everything away."""
    shifted = F.call_function("shiftleft", F.lit(U32_MAX).cast("bigint"), F.lit(32) - prefix_len.cast("int"))
    return F.when(prefix_len == 0, F.lit(0).cast("bigint")).otherwise(shifted.bitwiseAND(F.lit(U32_MAX)))


def cidr_network(ip: Column, prefix_len: Column) -> Column:
    return ip.bitwiseAND(cidr_mask(prefix_len))


def in_cidr(ip: Column, network: int, prefix_len: int) -> Column:
    mask = mask_of(prefix_len)
    return ip.bitwiseAND(F.lit(mask).cast("bigint")) == F.lit(network & mask).cast("bigint")


def cidr24(ip: Column) -> Column:
    return ip.bitwiseAND(F.lit(mask_of(24)).cast("bigint"))


def display_key(key_type: Column, ip: Column, dst_port: Column) -> Column:
    """``ip:port``, ``ip`` without a port, ``net/24`` for /24 keys."""
    text = long_to_ipv4(ip)
    return (
        F.when(key_type == "src_cidr24", F.concat(text, F.lit("/24")))
        .when(dst_port.isNotNull(), F.concat(text, F.lit(":"), dst_port.cast("string")))
        .otherwise(text)
    )


def flow_low(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    return F.least(src_ip * 65536 + src_port, dst_ip * 65536 + dst_port)


def flow_high(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    return F.greatest(src_ip * 65536 + src_port, dst_ip * 65536 + dst_port)
