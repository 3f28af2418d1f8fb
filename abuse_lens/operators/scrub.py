"""Dropping internal traffic and pseudonymising addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.functions import net
from abuse_lens.functions.hashing import hash_ipv4

# Fixed values of the frame layout.
MIN_IPV4_FRAME = 34
ETHERTYPE_IPV4 = "0800"


def parse_subnet(text: str) -> tuple[int, int]:
    """``A.B.C.D/N`` to (address as given, prefix length)."""
    address, slash, length = text.partition("/")
    if not slash or not length.isdigit():
        raise ValueError(f"subnet must be A.B.C.D/N, got {text!r}")
    if int(length) > 32:
        raise ValueError(f"prefix must be 0..32, got {length}")
    return int(ipaddress.IPv4Address(address)), int(length)


def internal(src_ip: Column, dst_ip: Column, subnet: str) -> Column:
    """Both ends lie in the subnet."""
    network, length = parse_subnet(subnet)
    return net.in_cidr(src_ip, network, length) & net.in_cidr(dst_ip, network, length)


def scrub_addresses(
    packets: DataFrame, salt: str | None = None, subnet: str | None = None, src: str = "src_ip", dst: str = "dst_ip"
) -> DataFrame:
    """Scrub address columns: internal packets go first, then both ends are hashed."""
    out = packets
    if subnet:
        out = out.where(~internal(F.col(src), F.col(dst), subnet))
    if salt:
        out = out.withColumns({src: hash_ipv4(F.col(src), salt), dst: hash_ipv4(F.col(dst), salt)})
    return out


def _address_at(frame: Column, position: int) -> Column:
    return F.conv(F.hex(F.substring(frame, position, 4)), 16, 10).cast("bigint")


def _four_bytes(ip: Column) -> Column:
    return F.unhex(F.lpad(F.hex(ip), 8, "0"))


def scrub_frames(packets: DataFrame, salt: str | None = None, subnet: str | None = None, frame: str = "pkt") -> DataFrame:
    """Scrub captured Ethernet frames in place.

    Frames too short for an IPv4 header and frames of another ethertype pass
    through unchanged.
    """
    pkt = F.col(frame)
    is_ipv4 = (F.length(pkt) >= MIN_IPV4_FRAME) & (F.hex(F.substring(pkt, 13, 2)) == ETHERTYPE_IPV4)
    src, dst = _address_at(pkt, 27), _address_at(pkt, 31)
    out = packets
    if subnet:
        out = out.where(~(F.coalesce(is_ipv4, F.lit(False)) & F.coalesce(internal(src, dst, subnet), F.lit(False))))
    if salt:
        hashed = F.concat(
            F.substring(pkt, 1, 26),
            _four_bytes(hash_ipv4(src, salt)),
            _four_bytes(hash_ipv4(dst, salt)),
            F.expr(f"substring({frame}, 35)"),
        )
        out = out.withColumn(frame, F.when(is_ipv4, hashed).otherwise(pkt))
    return out
