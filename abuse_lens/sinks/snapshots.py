"""Snapshot and heartbeat writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abuse_lens.functions.timetext import hour_name, hour_seconds
from abuse_lens.schema import STATUS
from abuse_lens.sinks import files, retention


def hourly(snapshots: DataFrame) -> DataFrame:
    """JSON lines with the UTC hour (``yyyyMMddHH``) they belong to."""
    columns = [c for c in snapshots.columns if c not in ("value", "file", "file_name", "hour")]
    return snapshots.select(hour_name(F.col("ts_unix_sec")).alias("hour"), F.to_json(F.struct(*columns)).alias("value"))


def append(snapshots: DataFrame, directory: str) -> None:
    """Append snapshots, one folder per UTC hour.

    The rebalance keeps small hours in few files and splits large ones over tasks.
    """
    hourly(snapshots).hint("rebalance", F.col("hour")).write.mode("append").partitionBy("hour").text(directory)


def read_hourly(spark: SparkSession, directory: str, first_hour: str | None = None, last_hour: str | None = None) -> DataFrame:
    """Lines written by :func:`append`; hours outside the range are never listed as input."""
    lines = spark.read.schema("value string, hour string").text(directory)
    if first_hour:
        lines = lines.where(F.col("hour") >= first_hour)
    if last_hour:
        lines = lines.where(F.col("hour") <= last_hour)
    return lines.select("value", F.col("_metadata.file_path").alias("file"))


def rotate(
    spark: SparkSession,
    directory: str,
    now: int,
    max_age_sec: int = retention.MAX_AGE_SEC,
    max_files: int = retention.MAX_FILES,
) -> dict[str, int]:
    """Remove hours that are too old, then the oldest beyond the limit.

    The folder listing is the table here; folders that are no hour stay.
    """
    hours = [(h,) for h in files.partition_values(spark, directory, "hour")]
    counts = {"removed_by_age": 0, "removed_by_count": 0}
    if not hours:
        return counts
    listed = spark.createDataFrame(hours, "hour string").withColumn("hour_ts", hour_seconds(F.col("hour")))
    judged = retention.verdicts(listed.where(F.col("hour_ts").isNotNull()), "hour_ts", now, max_age_sec, max_files)
    for row in judged.where(F.col("verdict") != "kept").collect():
        files.remove(spark, f"{directory}/hour={row['hour']}")
        counts[row["verdict"]] += 1
    return counts


def append_status(rows: DataFrame, path: str) -> None:
    """Append heartbeat lines (``timestamp, cycle, ips_collected, snapshots_written``)."""
    rows.select(*STATUS.fieldNames()).write.mode("append").json(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS).json(path)


def append_incident_status(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)
