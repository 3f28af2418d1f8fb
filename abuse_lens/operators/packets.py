"""Packet rows to per-source counters and back to snapshot lines.

Packet table: ``ts_ns, direction ('ingress'|'egress'), ip_version, proto,
src_ip, dst_ip, src_port, dst_port, fin/syn/ack/rst booleans, payload_len,
wire_len, cpu``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.functions import net
from abuse_lens.operators.slices import never_null, running_in_slices, slice_columns, with_slice
from abuse_lens.schema import AGGREGATION, COUNTER_MODE, COUNTERS, KEY_TYPES, SNAPSHOT_VERSION

# Fixed values of the capture.
IPV4 = 4
TCP = 6
SNAP_LENGTH = 256
NS = 1_000_000_000


def handshake_ack() -> Column:
    """A bare ACK: acknowledges, neither SYN nor RST, carries no payload."""
    return F.col("ack") & ~F.col("syn") & ~F.col("rst") & (F.col("payload_len") == 0)


def watched(packets: DataFrame, ports: list[int] | tuple[int, ...]) -> DataFrame:
    """IPv4 TCP packets towards (ingress) or from (egress) a watched port.

    The second condition follows from the last one, but on plain columns, so
    that it reaches the file scan.
    """
    wanted = [int(p) for p in ports]
    port = F.when(F.col("direction") == "egress", F.col("src_port")).otherwise(F.col("dst_port"))
    return packets.where(
        (F.col("ip_version") == IPV4)
        & (F.col("proto") == TCP)
        & (F.col("src_port").isin(wanted) | F.col("dst_port").isin(wanted))
        & port.isin(wanted)
    )


def _count(packets: DataFrame, extra_keys: list[str]) -> DataFrame:
    flag = lambda c: F.sum(c.cast("bigint"))
    return packets.groupBy("ip_u32", "dst_port", *extra_keys).agg(
        flag(F.col("syn")).alias("syn"),
        flag(F.col("ack")).alias("ack"),
        flag(handshake_ack()).alias("handshake_ack"),
        flag(F.col("rst")).alias("rst"),
        F.count(F.lit(1)).alias("packets"),
        F.sum("wire_len").alias("bytes"),
    )


def _keyed(packets: DataFrame, ip: str, port: str) -> DataFrame:
    rest = [c for c in packets.columns if c not in ("src_ip", "dst_ip", "src_port", "dst_port")]
    return packets.select(F.col(ip).alias("ip_u32"), F.col(port).alias("dst_port"), *rest)


def ingress_counters(packets: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Counters per (client address, server port) of packets reaching the server."""
    side = packets.where(F.col("direction") == "ingress")
    return _count(_keyed(side, "src_ip", "dst_port"), extra_keys or [])


def egress_counters(packets: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """The same buckets filled by the server's replies (peer address, own port)."""
    side = packets.where(F.col("direction") == "egress")
    return _count(_keyed(side, "dst_ip", "src_port"), extra_keys or [])


def both_counters(packets: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Both directions in one bucket: one scan, one partial aggregate, one shuffle."""
    out = F.col("direction") == "egress"
    rest = [c for c in packets.columns if c not in ("src_ip", "dst_ip", "src_port", "dst_port")]
    side = packets.where(F.col("direction").isin("ingress", "egress")).select(
        F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("ip_u32"),
        F.when(out, F.col("src_port")).otherwise(F.col("dst_port")).alias("dst_port"),
        *rest,
    )
    return _count(side, extra_keys or [])


def interval_counters(packets: DataFrame, interval_sec: int) -> DataFrame:
    """Counters per key and interval; ``ts`` is the start of the interval."""
    ns = interval_sec * NS
    ts = ((F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(ns))) / F.lit(NS).cast("decimal(20,0)")).cast("bigint")
    return both_counters(packets.withColumn("ts", ts), ["ts"])


def cumulative(counters: DataFrame, slice_sec: int) -> DataFrame:
    """Running totals per key: what a counter that is never reset shows at ``ts``.

    The slice column stays for the operators that follow on the same keys.
    """
    sliced, at = with_slice(never_null(counters, ["ip_u32", "dst_port"]), "ts", slice_sec)
    running = {f"_cum_{c}": ("sum", F.col(c)) for c in COUNTERS}
    out = running_in_slices(sliced, ["ip_u32", "dst_port"], ["ts"], at, running)
    return out.withColumns({c: F.col(f"_cum_{c}") for c in COUNTERS}).drop(*running)


def as_counter_rows(counters: DataFrame, base_ts: Column | None = None) -> DataFrame:
    """Per-key counters in the layout :mod:`abuse_lens.operators.deltas` reads."""
    return counters.select(
        "ts",
        (F.lit(None).cast("bigint") if base_ts is None else base_ts).alias("base_ts"),
        F.lit("").alias("seq"),
        F.lit(KEY_TYPES[0]).alias("key_type"),
        F.lit(0).alias("key_ord"),
        "ip_u32",
        "dst_port",
        *COUNTERS,
        *slice_columns(counters),
    )


def assemble_snapshots(
    counters: DataFrame,
    dst_ports: list[int] | tuple[int, ...],
    interval_sec: int,
    run_id: int,
    base_ts: int,
    parts: int = 1,
) -> DataFrame:
    """One snapshot row per ``ts`` with sorted buckets and sorted header ports.

    With ``parts`` above 1 every ``ts`` becomes up to so many rows with disjoint
    keys, so that no task builds a long array; readers see the same counters, and
    run counters count a ``ts`` once.  Give as many parts as a snapshot has
    hundred thousands of keys.
    """
    spread = counters.withColumn("part", F.pmod(F.xxhash64("key_ord", "ip_u32", "dst_port"), F.lit(parts)).cast("int"))
    bucket = F.struct("key_ord", "ip_u32", "dst_port", *COUNTERS)
    key_type = lambda b: F.element_at(F.array(*[F.lit(k) for k in KEY_TYPES]), b["key_ord"] + 1)
    shaped = F.transform(
        F.array_sort(F.collect_list(bucket)),
        lambda b: F.struct(
            key_type(b).alias("key_type"),
            net.long_to_ipv4(b["ip_u32"]).alias("src_ip"),
            b["dst_port"].cast("bigint").alias("dst_port"),
            *[b[c].alias(c) for c in COUNTERS],
        ),
    )
    return (
        spread.groupBy("ts", "part")
        .agg(shaped.alias("buckets"))
        .select(
            F.lit(SNAPSHOT_VERSION).cast("bigint").alias("version"),
            F.lit(AGGREGATION).alias("aggregation"),
            F.col("ts").alias("ts_unix_sec"),
            F.lit(interval_sec).cast("bigint").alias("interval_sec"),
            F.lit(run_id).cast("bigint").alias("run_id"),
            F.lit(COUNTER_MODE).alias("counter_mode"),
            F.lit(base_ts).cast("bigint").alias("base_ts_unix_sec"),
            F.array(*[F.lit(int(p)).cast("bigint") for p in sorted(dst_ports)]).alias("dst_ports"),
            "buckets",
        )
    )


def snapshot_json(snapshots: DataFrame) -> DataFrame:
    """Snapshot rows to (ts, JSON line); absent optional blocks are left out."""
    return snapshots.select(F.col("ts_unix_sec").alias("ts"), F.to_json(F.struct("*")).alias("value"))


def snapped(packets: DataFrame) -> DataFrame:
    """Captured length and bytes, at most 256; empty packets are not recorded."""
    return packets.where(F.col("wire_len") > 0).withColumns(
        {
            "cap_len": F.least(F.col("wire_len"), F.lit(SNAP_LENGTH).cast("bigint")).cast("int"),
            "pkt": F.substring(F.col("pkt"), 1, SNAP_LENGTH),
        }
    )


def wall_clock(packets: DataFrame, boot_anchor_ns: int) -> DataFrame:
    """Kernel nanoseconds plus a boot anchor to (sec, usec), negatives at zero."""
    unix_ns = F.greatest(F.col("ts_ns") + F.lit(boot_anchor_ns).cast("bigint"), F.lit(0).cast("bigint"))
    return (
        packets.withColumn("_unix_ns", unix_ns)
        .withColumn("sec", F.expr(f"_unix_ns div {NS}"))
        .withColumn("usec", F.expr(f"(_unix_ns % {NS}) div 1000"))
        .drop("_unix_ns")
    )


def boot_anchor_ns(unix_now_ns: int, monotonic_now_ns: int) -> int:
    return unix_now_ns - monotonic_now_ns
