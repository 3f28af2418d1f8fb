"""Validity rules, quarantine and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the event records.
PAYLOAD_SAMPLE_MAX = 1024
PACKET_CAPTURE_MAX = 256

PAYLOAD_DEFECTS = ("sample_len over 1024", "unknown direction", "sample shorter than sample_len")


def payload_defect() -> Column:
    """Why a payload event is rejected, null for a good one."""
    c = F.col
    return (
        F.when(c("sample_len") > PAYLOAD_SAMPLE_MAX, "sample_len over 1024")
        .when(~c("direction").isin(0, 1) | c("direction").isNull(), "unknown direction")
        .when(F.length("payload") < c("sample_len"), "sample shorter than sample_len")
    )


def packet_defect() -> Column:
    c = F.col
    return (
        F.when(c("cap_len") > PACKET_CAPTURE_MAX, "cap_len over 256")
        .when(c("cap_len") > c("wire_len"), "cap_len over wire_len")
        .when(~c("direction").isin(0, 1) | c("direction").isNull(), "unknown direction")
    )


def good_and_bad(events: DataFrame, defect: Column) -> tuple[DataFrame, DataFrame]:
    """Split events into the usable ones and a quarantine with its reason."""
    marked = events.withColumn("defect", defect)
    return marked.where(F.col("defect").isNull()).drop("defect"), marked.where(F.col("defect").isNotNull())


def event_quality(
    events: DataFrame, by: list[str], defect: Column, direction: Column, scrubbed: Column | None = None
) -> DataFrame:
    """Decode errors, events of no watched port and (if asked for) events scrubbed away, per window."""
    counts = [
        F.count(F.lit(1)).alias("events"),
        F.count_if(defect.isNotNull()).alias("decode_errors"),
        F.count_if(defect.isNull() & direction.isNull()).alias("events_filtered"),
    ]
    if scrubbed is not None:
        counts.append(F.count_if(defect.isNull() & scrubbed).alias("events_scrubbed"))
    return events.groupBy(*by).agg(*counts)


def window_results(
    counted: DataFrame, pairs: DataFrame, by: list[str], source_errors: DataFrame | None = None
) -> DataFrame:
    """:func:`event_quality` with each window's pairs, whether it has aggregates, and its source errors.

    ``pairs`` are the completed ones with the window columns, ``source_errors`` one row
    per error of the event source with them.
    """
    zero = F.lit(0).cast("bigint")
    out = counted.join(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs")), by, "left")
    if source_errors is not None:
        errors = source_errors.groupBy(*by).agg(F.count(F.lit(1)).alias("source_errors"))
        out = out.join(errors, by, "left").withColumn("source_errors", F.coalesce("source_errors", zero))
    pairs_seen = F.coalesce("n_pairs", zero)
    return out.withColumns({"n_pairs": pairs_seen, "has_aggregates": pairs_seen > 0})


def run_totals(per_window: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Window counters summed over a run."""
    sums = [c for c in per_window.columns if c not in (by or []) and c not in ("window",)]
    return per_window.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("windows_completed"), *[F.sum(c).alias(f"total_{c}") for c in sums]
    )


def collection_result(snapshots: DataFrame) -> DataFrame:
    """Per run: cycles, buckets (address and port pairs) and snapshots written.

    The rows of one run and ``ts`` are the parts of one snapshot.
    """
    return _cycles(snapshots).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cycles"),
        F.sum("buckets").alias("total_ips"),
        F.count(F.lit(1)).alias("snapshots_written"),
    )


def _cycles(snapshots: DataFrame) -> DataFrame:
    """One row per run and ``ts``, however many rows a snapshot was written in."""
    return snapshots.groupBy("run_id", "ts_unix_sec").agg(F.sum(F.size("buckets")).alias("buckets"))


def heartbeats(snapshots: DataFrame) -> DataFrame:
    """One status row per snapshot; ``ips_collected`` counts buckets."""
    from abuse_lens.operators.slices import row_number_in_slices, with_slice

    rows = _cycles(snapshots).select(
        F.coalesce("run_id", F.lit(-1).cast("bigint")).alias("run_id"),
        F.col("ts_unix_sec").alias("timestamp"),
        F.col("buckets").alias("ips_collected"),
    )
    sliced, at = with_slice(rows, "timestamp", 86400)
    numbered = row_number_in_slices(sliced, ["run_id"], ["timestamp"], at, "cycle")
    return numbered.select("timestamp", "cycle", "ips_collected", F.col("cycle").alias("snapshots_written"))


INCIDENT_COUNTERS = (
    "events_written",
    "events_decode_errors",
    "events_write_errors",
    "events_scrubbed",
    "rotations",
    "size_driven_rotations",
    "poll_errors",
    "archived",
    "archive_errors",
)


def incident_status(counters: DataFrame) -> DataFrame:
    """Incident heartbeat lines from rows of ``timestamp, cycle`` and counters."""
    have = set(counters.columns)
    zero = F.lit(0).cast("bigint")
    fields = [(F.col(n) if n in have else zero).alias(n) for n in INCIDENT_COUNTERS]
    return counters.select(F.to_json(F.struct("timestamp", "cycle", *fields)).alias("value"))
