"""Traffic tables derived from the given parquet tables.

Every event becomes one packet and every conversation turn one message, so the
work grows with the inputs.  The SQL twins of these derivations are in
:mod:`abuse_lens.workload.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abuse_lens.config import ReportConfig
from abuse_lens.functions.timetext import micros_from_ntz
from abuse_lens.operators import deltas, packets

DAY = 86400
CLIENT_NET = 167772160  # 10.0.0.0
SERVER_NET = 3232235776  # 192.168.1.0
PORTS = (8000, 8001)
SALT = "0123456789abcdef"
ALLOW_LINES = ["# monitoring", "10.0.0.5", "10.0.0.64/28", "", "  10.0.0.9  "]
SLICE_DAYS = 10
START_NS = 1_704_067_200_000_000_000  # 2024-01-01

CFG = ReportConfig(
    dst_ports=PORTS,
    window_sec=10 * DAY,
    syn_rate_threshold=1 / DAY,
    success_ratio_threshold=0.5,
    vol_syn_rate=1 / DAY,
    vol_pkt_rate=4 / DAY,
    vol_byte_rate=16000 / DAY,
    slice_intervals=SLICE_DAYS,
)
EPISODE_CFG = CFG.with_(success_ratio_threshold=0.1, vol_pkt_rate=3 / DAY, vol_byte_rate=8000 / DAY)


class Streaming:
    """Stands for a session in the table functions below; tables become streams of their files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark


def read(spark: SparkSession | Streaming, sf_dir: str, table: str) -> DataFrame:
    if isinstance(spark, Streaming):
        schema = spark.spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
        return spark.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``k`` out of the JSON property.

    A generator reads the JSON once per row; as an expression it would be
    copied into every filter and column that mentions ``k``.
    """
    return (
        read(spark, sf_dir, "events")
        .select("event_id", "ts", "user_id", "event_type", "value", F.json_tuple("props", "k").alias("k"))
        .withColumn("k", F.col("k").cast("int"))
    )


def packet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as packets: every fifth one a reply of the server."""
    c = F.col
    kind = c("event_type")
    egress = c("event_id") % 5 == 4
    raw = (
        read_events(spark, sf_dir)
        .select(
            "event_id",
            "k",
            (micros_from_ntz(c("ts")) * 1000).alias("ts_ns"),
            F.when(egress, "egress").otherwise("ingress").alias("direction"),
            F.when(c("k") == 98, 6).otherwise(4).alias("ip_version"),
            F.when(c("k") == 99, 17).otherwise(6).alias("proto"),
            (F.lit(CLIENT_NET) + c("user_id")).alias("client_ip"),
            (F.lit(SERVER_NET) + 1 + c("k") % 4).alias("server_ip"),
            (F.lit(40000) + c("event_id") % 1000).cast("int").alias("client_port"),
            F.when(c("k") == 97, 9000).otherwise(F.lit(8000) + c("k") % 2).cast("int").alias("server_port"),
            (kind == "error").alias("syn"),
            kind.isin("signup", "click", "view").alias("ack"),
            (kind == "purchase").alias("rst"),
            F.when(kind == "signup", F.lit(0)).otherwise(F.round(c("value") * 100)).cast("bigint").alias("payload_len"),
            F.round(c("value") * 100).cast("bigint").alias("wire_len"),
            (c("user_id") % 4).cast("int").alias("cpu"),
        )
    )
    out = c("direction") == "egress"
    either = lambda a, b: F.when(out, c(a)).otherwise(c(b))
    return raw.select(
        "event_id",
        "k",
        "ts_ns",
        "direction",
        "ip_version",
        "proto",
        either("server_ip", "client_ip").alias("src_ip"),
        either("client_ip", "server_ip").alias("dst_ip"),
        either("server_port", "client_port").alias("src_port"),
        either("client_port", "server_port").alias("dst_port"),
        "syn",
        "ack",
        "rst",
        "payload_len",
        "wire_len",
        "cpu",
    )


def daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.interval_counters(packets.watched(packet_table(spark, sf_dir), PORTS), DAY)


def cumulative_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter rows as a collector would have written them, day by day."""
    running = packets.cumulative(daily_counters(spark, sf_dir), SLICE_DAYS * DAY)
    return packets.as_counter_rows(running)


def delta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.with_deltas(cumulative_counters(spark, sf_dir), SLICE_DAYS * DAY)


def message_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as completed messages of one flow per conversation."""
    c = F.col
    direction = F.when(c("role") == "user", "to_server").when(c("role") == "assistant", "from_server")
    return (
        read(spark, sf_dir, "conversations")
        .withColumn("direction", direction)
        .where(c("direction").isNotNull())
        .select(
            c("conv_id").alias("flow"),
            "turn",
            "direction",
            F.length("text").cast("bigint").alias("body_len"),
            (c("conv_id") * 60_000_000_000 + c("turn") * 1_000_000_000).alias("first_ts"),
            (c("conv_id") * 60_000_000_000 + c("turn") * 1_000_000_000 + F.length("text") * 1000).alias("done_ts"),
            F.when(c("turn") % 8 == 1, F.lit(None).cast("int"))
            .otherwise(F.element_at(F.array(*[F.lit(s) for s in (200, 404, 500, 302)]), (F.length("text") % 4 + 1).cast("int")))
            .alias("status"),
            (F.length("text") % 3 == 0).alias("rpc_parsed"),
            F.when(F.length("text") % 6 == 0, -32000 - F.length("text") % 7).alias("rpc_error_code"),
            (F.lit(30000) + c("conv_id") % 7).cast("int").alias("client_port"),
        )
    )


def trigger_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as operator commands: stops, rate changes, triggers, bad ones among them."""
    c = F.col
    return (
        read_events(spark, sf_dir)
        .where(c("event_type") == "purchase")
        .select(
            F.call_function("div", micros_from_ntz(c("ts")), F.lit(1_000_000).cast("bigint")).alias("ts"),
            c("event_id").alias("seq"),
            F.when(c("k") < 25, "stop").when(c("k") < 50, "set-sample-rate").otherwise("trigger").alias("action"),
            F.when(c("k") % 10 == 9, "bad tag").otherwise(F.concat(F.lit("inc-"), c("user_id").cast("string"))).alias("tag"),
            F.when(c("k") < 25, F.lit(None)).when(c("k") < 50, c("k") % 4).otherwise(1 + c("k") % 5).cast("bigint").alias("rate"),
            F.when((c("k") >= 50) & (c("k") % 3 > 0), (c("k") % 3) * 600).cast("bigint").alias("duration_sec"),
        )
    )


def host_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of the process ``user_id``; missing readings come from ``k``."""
    c = F.col
    return (
        read_events(spark, sf_dir)
        .select(
            c("user_id").alias("pid"),
            c("ts").alias("captured_at"),
            F.when(c("k") % 11 != 0, c("event_id") * 7 % 100000).alias("cpu_jiffies"),
            F.when(c("k") % 13 != 0, F.round(c("value") * 100).cast("bigint") * 4096).alias("rss_bytes"),
            F.when(c("k") % 17 != 0, (c("k") + 3).cast("bigint")).alias("num_fds"),
            F.when(c("k") % 7 != 0, (c("k") * 2).cast("bigint")).alias("num_connections"),
            F.when(c("k") % 5 != 0, c("event_id") * 512).alias("io_write_bytes"),
        )
    )


def payload_events(spark: SparkSession, sf_dir: str, segment: int = 700, rpc: bool = False) -> DataFrame:
    """Conversations as HTTP messages cut into TCP segments of one connection each.

    With ``rpc`` two of three responses are JSON-RPC, every other of these an error.
    """
    c = F.col
    request = c("role") == "user"
    kind = F.length("text") % 3
    code = (F.lit(-32600) - F.length("text") % 7).cast("string")
    reply = F.when(kind == 0, F.lit('{"jsonrpc":"2.0","result":{"a":1,"a":2}}')).when(
        kind == 1, F.concat(F.lit('{"jsonrpc":"2.0","error":{"code":'), code, F.lit("}}"))
    )
    said = F.when(F.lit(rpc) & ~request & reply.isNotNull(), reply).otherwise(c("text"))
    body = F.encode(said, "UTF-8")
    head = F.when(
        request,
        F.concat(F.lit("POST /rpc HTTP/1.1\r\nHost: h\r\ncontent-length: "), F.octet_length(said).cast("string"), F.lit("\r\n\r\n")),
    ).otherwise(
        F.concat(
            F.lit("HTTP/1.1 "),
            F.element_at(F.array(*[F.lit(s) for s in ("200", "404", "500", "302")]), (F.length("text") % 4 + 1).cast("int")),
            F.lit(" X\r\nContent-Length: "),
            F.octet_length(said).cast("string"),
            F.lit("\r\nServer: s\r\n\r\n"),
        )
    )
    client = F.lit(CLIENT_NET) + c("conv_id") % 65536
    server = F.lit(SERVER_NET + 1)
    client_port = (F.lit(20000) + F.call_function("div", c("conv_id"), F.lit(65536).cast("bigint"))).cast("int")
    either = lambda a, b: F.when(request, a).otherwise(b)
    return (
        read(spark, sf_dir, "conversations")
        .where(c("role").isin("user", "assistant"))
        .select(
            either(client, server).alias("src_ip"),
            either(server, client).alias("dst_ip"),
            either(client_port, F.lit(8899)).cast("int").alias("src_port"),
            either(F.lit(8899), client_port).cast("int").alias("dst_port"),
            either(F.lit(0), F.lit(1)).alias("direction"),
            (F.lit(START_NS) + c("turn") * 1_000_000_000).alias("turn_ns"),
            F.concat(F.encode(head, "UTF-8"), body).alias("message"),
        )
        .select(
            "*",
            F.explode(F.sequence(F.lit(0), F.call_function("div", F.length("message") - 1, F.lit(segment)).cast("int"))).alias("part"),
        )
        .withColumn("payload", F.expr(f"substring(message, part * {segment} + 1, {segment})"))
        .select(
            "src_ip",
            "dst_ip",
            "src_port",
            "dst_port",
            "direction",
            (c("part") * segment).cast("bigint").alias("tcp_seq"),
            (c("turn_ns") + c("part") * 1000).alias("ts_ns"),
            F.length("payload").cast("bigint").alias("payload_len"),
            F.length("payload").alias("sample_len"),
            "payload",
        )
    )


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with the first bytes of their Ethernet frame."""
    c = F.col
    hexed = lambda x, n: F.lpad(F.hex(x), n, "0")
    frame = F.concat(
        F.lit("0A0000000001" + "0A0000000002"),
        F.when(c("ip_version") == 4, "0800").otherwise("86DD"),
        F.lit("45000028000000004006" + "0000"),
        hexed(c("src_ip"), 8),
        hexed(c("dst_ip"), 8),
        hexed(c("src_port"), 4),
        hexed(c("dst_port"), 4),
    )
    return packet_table(spark, sf_dir).withColumn("pkt", F.unhex(frame))


def snapshot_lines_with_faults(spark: SparkSession, sf_dir: str, *keep: Column) -> DataFrame:
    """Every event as one snapshot line; ``k`` decides which fault it carries.  ``keep`` are more columns of the events."""
    c = F.col
    e = read_events(spark, sf_dir)
    bucket = F.concat(
        F.lit('{"key_type":"'), F.when(c("k") == 1, "src_net").otherwise("src_ip"),
        F.lit('","src_ip":"'), F.when(c("k") == 2, "10.0.0.300").when(c("k") == 3, "10.0.01.1").otherwise("10.0.0.1"),
        F.lit('","dst_port":'), F.when(c("k") == 4, "70000").when(c("k") == 5, "null").otherwise("8000"),
        F.lit(',"syn":'), F.when(c("k") == 6, "4294967296").when(c("k") == 7, "1.5").when(c("k") == 8, "-1").otherwise("1"),
        F.when(c("k") == 9, "").otherwise(',"ack":1'),
        F.when(c("k") == 10, ',"ack":2').otherwise(""),
        F.when(c("k") == 11, ',"extra":2').otherwise(""),
        F.lit(',"handshake_ack":1,"rst":0,"packets":'), c("event_id").cast("string"), F.lit(',"bytes":100}'),
    )
    line = F.concat(
        F.lit('{"version":'), F.when(c("k") == 12, "4").when(c("k") == 13, "8").otherwise((F.lit(5) + c("k") % 3).cast("string")),
        F.lit(',"aggregation":"src_ip_dst_port","ts_unix_sec":'), c("event_id").cast("string"),
        F.lit(',"interval_sec":60,"run_id":1,"counter_mode":"cumulative",'),
        F.when(c("k") == 14, "").otherwise('"base_ts_unix_sec":0,'),
        F.when(c("k") == 15, '"note":{"a":[1]},').otherwise(""),
        F.lit('"dst_ports":['), F.when(c("k") == 16, "65536").otherwise("8000"), F.lit('],"buckets":['),
        bucket, F.when(c("k") == 17, "").otherwise("]}"),
    )
    return e.select(
        F.when(c("k") == 18, "   ").when(c("k") == 19, F.concat(F.lit(" \t"), line, F.lit("  "))).otherwise(line).alias("value"), *keep
    )


def meter_readings(spark: SparkSession | Streaming, sf_dir: str) -> DataFrame:
    """Every event as one reading of its user's counters; some of them fall back."""
    c = F.col
    reading = lambda x: x.cast("bigint")
    return read_events(spark, sf_dir).select(
        div_bigint(micros_from_ntz(c("ts")), 1_000_000).alias("ts"),
        F.lit(0).cast("bigint").alias("base_ts"),
        F.lpad(c("event_id").cast("string"), 18, "0").alias("seq"),
        F.lit("src_ip").alias("key_type"),
        F.lit(0).alias("key_ord"),
        (F.lit(CLIENT_NET) + c("user_id")).alias("ip_u32"),
        F.lit(8000).alias("dst_port"),
        reading(c("event_id") * 40 + c("k") * 1000).alias("syn"),
        reading(c("event_id")).alias("ack"),
        reading(c("event_id") * 2 + c("k") * 10).alias("handshake_ack"),
        reading(c("k")).alias("rst"),
        reading(c("event_id") * 50 + c("k")).alias("packets"),
        reading(c("event_id") * 4000).alias("bytes"),
    )


def div_bigint(a, b: int):
    return F.call_function("div", a, F.lit(b).cast("bigint"))
