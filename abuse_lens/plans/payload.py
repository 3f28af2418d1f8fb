"""Window features and host telemetry as snapshots of the payload mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abuse_lens.operators.rpc import with_idle_windows
from abuse_lens.schema import AGGREGATION, COUNTER_MODE, HOST_TELEMETRY, RESP_AGGREGATES, SNAPSHOT, SNAPSHOT_VERSION


def _block(kind: StructType, present):
    return F.when(present, F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields]))


def payload_snapshots(
    features: DataFrame,
    window: str,
    interval_sec: int,
    dst_ports: list[int] | tuple[int, ...],
    run_id: int,
    base_ts: int,
    host: DataFrame | None = None,
) -> DataFrame:
    """One snapshot per window, stamped with the window's end; no buckets.

    ``features`` come from ``rpc.response_aggregates`` with the window's start
    second in ``window``.  A window without pairs still gives a snapshot, with
    neither aggregates nor port counts; ``host`` rows (same window column) are
    attached wherever there are some.
    """
    every = with_idle_windows(features, window, interval_sec)
    aggregates = _block(RESP_AGGREGATES, F.col("count").isNotNull())
    rows = every.select(window, aggregates.alias("resp_aggregates"))
    if host is None:
        rows = rows.withColumn("host", F.lit(None).cast(HOST_TELEMETRY))
    else:
        known = host.select(window, _block(HOST_TELEMETRY, F.lit(True)).alias("host"))
        rows = rows.join(known, window, "left")
    return rows.select(
        F.lit(SNAPSHOT_VERSION).cast("bigint").alias("version"),
        F.lit(AGGREGATION).alias("aggregation"),
        (F.col(window) + interval_sec).cast("bigint").alias("ts_unix_sec"),
        F.lit(interval_sec).cast("bigint").alias("interval_sec"),
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(COUNTER_MODE).alias("counter_mode"),
        F.lit(base_ts).cast("bigint").alias("base_ts_unix_sec"),
        F.array(*[F.lit(int(p)).cast("bigint") for p in sorted(dst_ports)]).alias("dst_ports"),
        F.array().cast(SNAPSHOT["buckets"].dataType).alias("buckets"),
        "resp_aggregates",
        "host",
    )
