"""Host telemetry between two samples of a process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.functions.timetext import micros_from_ntz
from abuse_lens.operators.slices import lag_in_slices, with_slice

# Fixed values.
CLOCK_TICKS = 100
MIN_ELAPSED_SEC = 0.1

SAMPLES = ["cpu_jiffies", "rss_bytes", "num_fds", "num_connections", "io_write_bytes"]


def host_deltas(samples: DataFrame, slice_sec: int = 86400, ticks: int = CLOCK_TICKS) -> DataFrame:
    """Change of every sample against the process's sample before.

    A value missing on either side leaves its own outputs null.  Rates need at
    least 0.1 s between the samples; CPU ticks never count backwards.
    """
    instant = dict(samples.dtypes)["captured_at"] == "timestamp"
    at = F.col("captured_at")
    timed = samples.withColumn("_us", F.unix_micros(at) if instant else micros_from_ntz(at)).withColumn(
        "_pid", F.coalesce(F.col("pid").cast("bigint"), F.lit(-1).cast("bigint"))
    )
    sliced, slice_col = with_slice(timed, "_us", slice_sec * 1_000_000)
    lagged = lag_in_slices(sliced, ["_pid"], ["_us", *SAMPLES], slice_col, ["_us", *SAMPLES])
    c = F.col
    elapsed = F.greatest(c("_us") - c("prev._us"), F.lit(0).cast("bigint")).cast("double") / 1e6
    long_enough = elapsed >= MIN_ELAPSED_SEC

    def change(name: str) -> Column:
        return c(name) - c(f"prev.{name}")

    known = lambda name: change(name).isNotNull()
    jiffies = F.greatest(change("cpu_jiffies"), F.lit(0).cast("bigint"))
    cpu = F.when(
        known("cpu_jiffies") & long_enough & F.lit(ticks > 0), jiffies.cast("double") / float(ticks or 1) / elapsed * 100.0
    )
    return lagged.where(c("prev").isNotNull()).select(
        "pid",
        "captured_at",
        cpu.alias("cpu_mean"),
        cpu.alias("cpu_max"),
        change("rss_bytes").alias("rss_delta"),
        F.when(known("rss_bytes"), c("rss_bytes")).alias("rss_max"),
        F.when(long_enough, change("rss_bytes").cast("double") / elapsed).alias("rss_slope_bps"),
        change("num_fds").alias("num_fds_delta"),
        change("num_connections").alias("num_connections_delta"),
        F.when(known("num_connections"), c("num_connections")).alias("num_connections_max"),
        change("io_write_bytes").alias("io_write_delta"),
    )
