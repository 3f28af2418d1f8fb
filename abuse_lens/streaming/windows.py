"""Streaming window features and the streaming snapshot sink.

The windows run on event time: a row later than the watermark is dropped.
Empty windows emit nothing here (see ``features.with_empty_windows``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from abuse_lens.operators import packets as pk
from abuse_lens.operators import rpc
from abuse_lens.plans.settle import settle, shared_folder
from abuse_lens.sinks.snapshots import hourly

WINDOW_SEC = 60


def event_time(df: DataFrame, ns_column: str, lateness: str) -> DataFrame:
    """Add ``event_time`` from nanoseconds and its watermark."""
    micros = F.call_function("div", F.col(ns_column), F.lit(1000).cast("bigint"))
    return df.withColumn("event_time", F.timestamp_micros(micros)).withWatermark("event_time", lateness)


def pair_windows(pairs: DataFrame, window_sec: int = WINDOW_SEC, lateness: str = "10 seconds") -> DataFrame:
    """Window features of a stream of pairs, by response completion.

    These need one group a window; see ``features.window_features`` for all of them, medians and distinct counts included.
    """
    c = F.col
    ratio = rpc.amp_ratio()
    return (
        event_time(pairs, "resp_completed_ns", lateness)
        .groupBy(F.window("event_time", f"{window_sec} seconds"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("response_bytes").alias("resp_bytes_total"),
            F.max("request_bytes").alias("req_bytes_max"),
            F.max("response_bytes").alias("resp_bytes_max"),
            F.avg(ratio).alias("amp_ratio_mean"),
            F.max(ratio).alias("amp_ratio_max"),
            F.max(rpc.duration_ns()).alias("duration_ns_max"),
            F.count_if(c("status_code").between(200, 299)).alias("status_2xx"),
            F.count_if(c("status_code").between(400, 499)).alias("status_4xx"),
            F.count_if(c("status_code").between(500, 599)).alias("status_5xx"),
            F.count("status_code").alias("status_parsed"),
        )
        .select(F.unix_seconds("window.start").alias("window_start"), "*")
        .drop("window")
    )


def counter_windows(packets: DataFrame, ports, window_sec: int = WINDOW_SEC, lateness: str = "10 seconds") -> DataFrame:
    """Per-key packet counters of each window of a packet stream."""
    out = F.col("direction") == "egress"
    timed = event_time(pk.watched(packets, ports), "ts_ns", lateness)
    flag = lambda x: F.sum(x.cast("bigint"))
    return (
        timed.groupBy(
            F.window("event_time", f"{window_sec} seconds"),
            F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("ip_u32"),
            F.when(out, F.col("src_port")).otherwise(F.col("dst_port")).alias("dst_port"),
        )
        .agg(
            flag(F.col("syn")).alias("syn"),
            flag(F.col("ack")).alias("ack"),
            flag(pk.handshake_ack()).alias("handshake_ack"),
            flag(F.col("rst")).alias("rst"),
            F.count(F.lit(1)).alias("packets"),
            F.sum("wire_len").alias("bytes"),
        )
        .select(F.unix_seconds("window.start").alias("ts"), "*")
        .drop("window")
    )


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what its source holds now; its output as a table.

    Output and progress go to the shared folder, not through the driver.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start(f"{base}/rows")
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def replay(
    table: DataFrame, turn: Column, build: Callable[[DataFrame], DataFrame], closing: DataFrame, files_per_trigger: int = 8,
    ended: Callable[[str], object] | None = None,
) -> DataFrame:
    """Run a stream over files that arrive in the order of ``turn``, and read what it has written.

    ``turn`` has few values; each one's rows are written as files of their own, no more than a batch takes.
    ``closing`` rows come last and move the watermark behind all others, so that
    what waits in a state is given out; they should have a key of their own.
    ``ended`` is called with the run id of each run that has ended.
    """
    spark = table.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    settled = settle(table.withColumn("_turn", turn))
    turns = sorted(r[0] for r in settled.select("_turn").distinct().collect())
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)

    def go_on(rows: DataFrame) -> None:
        rows.select(*table.columns).coalesce(files_per_trigger).write.mode("append").parquet(f"{base}/in")

    def take_all() -> DataFrame:
        stream = build(source.parquet(f"{base}/in"))
        running = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{base}/progress")
            .trigger(availableNow=True)
            .start(f"{base}/rows")
        )
        running.awaitTermination()
        if ended is not None:
            ended(str(running.runId))
        return stream

    for value in turns:
        go_on(settled.where(F.col("_turn") == value))
    take_all()
    go_on(closing)
    return spark.read.schema(take_all().schema).parquet(f"{base}/rows")


def write_snapshots(snapshots: DataFrame, directory: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of snapshot rows to hourly folders."""
    return (
        hourly(snapshots)
        .writeStream.format("text")
        .partitionBy("hour")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start(directory)
    )
