"""Small builders shared by the tests."""

from __future__ import annotations

import glob
import json

COUNTER_SCHEMA = (
    "ts bigint, base_ts bigint, seq string, key_type string, key_ord int, ip_u32 bigint, dst_port int, "
    "syn bigint, ack bigint, handshake_ack bigint, rst bigint, packets bigint, bytes bigint"
)


def bucket(ip, syn, ack, hs, rst, packets, size, port=8080, key_type="src_ip"):
    return {
        "key_type": key_type, "src_ip": ip, "dst_port": port, "syn": syn, "ack": ack, "handshake_ack": hs,
        "rst": rst, "packets": packets, "bytes": size,
    }


def snapshot(ts, buckets, version=7, base_ts=1000, interval=60, run_id=1000, ports=(8080,)):
    return {
        "version": version, "aggregation": "src_ip_dst_port", "ts_unix_sec": ts, "interval_sec": interval,
        "run_id": run_id, "counter_mode": "cumulative", "base_ts_unix_sec": base_ts, "dst_ports": list(ports),
        "buckets": buckets,
    }


def lines(spark, items):
    texts = [(i if isinstance(i, str) else json.dumps(i, separators=(",", ":")),) for i in items]
    return spark.createDataFrame(texts, "value string")


def counter(ts, syn, ip=167772161, port=8080, base_ts=0, hs=0, ack=0, rst=0, packets=None, size=None, seq="", ord_=0):
    packets = syn if packets is None else packets
    size = packets * 100 if size is None else size
    return (ts, base_ts, seq, "src_ip", ord_, ip, port, syn, ack, hs, rst, packets, size)


def counters(spark, rows):
    return spark.createDataFrame(rows, COUNTER_SCHEMA)


def read_document(path):
    """Concatenate the ordered parts of a written document."""
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))
