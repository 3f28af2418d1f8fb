"""Explicit schemas.  Nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the snapshot format.
SNAPSHOT_VERSION = 7
READABLE_VERSIONS = (5, 6, 7)
AGGREGATION = "src_ip_dst_port"
COUNTER_MODE = "cumulative"
KEY_TYPES = ("src_ip", "src_cidr24")  # in rank order
U16_MAX = 65535
U32_MAX = 4294967295

COUNTERS = ("syn", "ack", "handshake_ack", "rst", "packets", "bytes")

_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "binary": T.BinaryType(),
}


def _flat(fields: str) -> T.StructType:
    """``name type, name type`` to a schema; unlike DDL parsing it needs no session."""
    pairs = (f.split() for f in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BUCKET = T.StructType(
    [
        T.StructField("key_type", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_port", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
    ]
)

RESP_AGGREGATES = _flat(
    "count bigint, resp_bytes_total bigint, req_bytes_max bigint, resp_bytes_max bigint, "
    "amp_ratio_mean double, amp_ratio_median double, amp_ratio_max double, "
    "unique_dst_ports bigint, unique_src_ports bigint, duration_ns_mean bigint, duration_ns_max bigint, "
    "status_2xx_frac double, status_4xx_frac double, status_5xx_frac double, "
    "rpc_error_distinct_codes bigint, rpc_error_frac double, req_bytes_mean double, resp_bytes_mean double"
)

HOST_TELEMETRY = _flat(
    "cpu_mean double, cpu_max double, rss_delta bigint, rss_max bigint, rss_slope_bps double, "
    "num_fds_delta bigint, num_connections_delta bigint, num_connections_max bigint, io_write_delta bigint"
)

SNAPSHOT = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("aggregation", T.StringType()),
        T.StructField("ts_unix_sec", T.LongType()),
        T.StructField("interval_sec", T.LongType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("counter_mode", T.StringType()),
        T.StructField("base_ts_unix_sec", T.LongType()),
        T.StructField("dst_ports", T.ArrayType(T.LongType())),
        T.StructField("buckets", T.ArrayType(BUCKET)),
        T.StructField("resp_aggregates", RESP_AGGREGATES),
        T.StructField("host", HOST_TELEMETRY),
    ]
)

STATUS = _flat("timestamp bigint, cycle bigint, ips_collected bigint, snapshots_written bigint")

PAYLOAD_EVENTS = _flat(
    "src_ip bigint, dst_ip bigint, src_port int, dst_port int, direction int, tcp_seq bigint, "
    "ts_ns bigint, payload_len bigint, sample_len int, payload binary"
)

PACKET_EVENTS = _flat(
    "ts_ns bigint, ifindex int, direction int, wire_len bigint, cap_len int, pkt binary"
)

TRIGGER_LOG = _flat("ts bigint, action string, tag string, rate bigint, duration_sec bigint")
