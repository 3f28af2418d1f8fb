"""Hot intervals and the episodes they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.config import DEFAULT_INTERVAL_SEC, SYN_FLOOD, VOLUMETRIC, ReportConfig
from abuse_lens.functions import net
from abuse_lens.functions.numbers import fixed
from abuse_lens.operators.deltas import KEY, named
from abuse_lens.operators.slices import never_null, running_in_slices, with_slice, without_slices


def volumetric_hits(cfg: ReportConfig, syn: Column, pkt: Column, byte: Column) -> Column:
    """How many of the three volume thresholds are reached (0 to 3)."""
    reached = [syn >= cfg.vol_syn_rate, pkt >= cfg.vol_pkt_rate, byte >= cfg.vol_byte_rate]
    return sum((r.cast("int") for r in reached[1:]), reached[0].cast("int"))


def syn_flood(cfg: ReportConfig, syn_rate: Column, success_ratio: Column) -> Column:
    return (syn_rate >= cfg.syn_rate_threshold) & (success_ratio <= cfg.success_ratio_threshold)


def is_hot(cfg: ReportConfig) -> Column:
    """An interval is hot on a SYN flood or on two of the three volumes."""
    c = F.col
    flood = syn_flood(cfg, c("syn_rate"), c("success_ratio"))
    return flood | (volumetric_hits(cfg, c("syn_rate"), c("pkt_rate"), c("byte_rate")) >= 2)


def hot_runs(intervals: DataFrame, cfg: ReportConfig, interval_sec: int) -> DataFrame:
    """Hot intervals with ``run``: the position of the last cold interval before.

    Consecutive hot rows of a key share the same last cold row, whatever gaps
    the timestamps have; the position packs (ts, seq) so ties stay ordered.
    """
    marked = intervals.withColumn("hot", is_hot(cfg))
    cold_at = F.when(~F.col("hot"), F.struct("ts", "seq"))
    keys = [*KEY, "run_key"]
    sliced, at = with_slice(marked, "ts", cfg.slice_intervals * interval_sec)
    runs = running_in_slices(never_null(sliced, [*keys, at]), keys, ["ts", "seq"], at, {"run": ("max", cold_at)})
    return without_slices(runs.where("hot").drop("hot"))


def detect_episodes(
    intervals: DataFrame, cfg: ReportConfig, interval_sec: int = DEFAULT_INTERVAL_SEC
) -> DataFrame:
    """Runs of consecutive hot intervals, one row each, classified."""
    c = F.col
    runs = hot_runs(intervals, cfg, interval_sec)
    grouped = runs.groupBy(*KEY, "run_key", "run").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("interval_count"),
        F.max("syn_rate").alias("max_syn_rate"),
        F.max("pkt_rate").alias("max_pkt_rate"),
        F.max("byte_rate").alias("max_byte_rate"),
        F.coalesce(F.min(F.when(c("syn") > 0, c("success_ratio"))), F.lit(0.0)).alias("min_success_ratio"),
        F.sum("syn").alias("total_syn"),
        F.sum("packets").alias("total_packets"),
        F.sum("bytes").alias("total_bytes"),
    )
    return (
        named(grouped.where(c("interval_count") >= cfg.min_episode_intervals))
        .withColumns(
            {
                "src_ip": net.long_to_ipv4(c("ip_u32")),
                "duration_sec": c("end_ts") - c("start_ts") + F.lit(interval_sec).cast("bigint"),
                "interval_sec": F.lit(interval_sec).cast("bigint"),
                "episode_type": F.when(c("interval_count") == 1, "single_window").otherwise("multi_window"),
                "abuse_class": episode_class(cfg),
            }
        )
        .drop("run", "run_key", "port_key")
    )


def episode_class(cfg: ReportConfig) -> Column:
    """Class from the episode's own extremes; a SYN flood always comes first."""
    c = F.col
    hits = volumetric_hits(cfg, c("max_syn_rate"), c("max_pkt_rate"), c("max_byte_rate"))
    return F.when(syn_flood(cfg, c("max_syn_rate"), c("min_success_ratio")), SYN_FLOOD).when(hits >= 2, VOLUMETRIC)


def trigger_reason(cfg: ReportConfig) -> Column:
    """Text that names the thresholds an episode reached."""
    c = F.col

    def reached(name: str, value: Column, limit: float) -> Column:
        text = F.concat(F.lit(f"{name} "), fixed(value, 1), F.lit(f" >= {limit:.1f}"))
        return F.when(value >= limit, text)

    flood = F.concat(
        F.lit("syn_rate "),
        fixed(c("max_syn_rate"), 1),
        F.lit(f" >= {cfg.syn_rate_threshold:.1f} AND success_ratio "),
        fixed(c("min_success_ratio"), 4),
        F.lit(f" <= {cfg.success_ratio_threshold:.4f}"),
    )
    parts = F.concat_ws(
        ", ",
        reached("syn_rate", c("max_syn_rate"), cfg.vol_syn_rate),
        reached("pkt_rate", c("max_pkt_rate"), cfg.vol_pkt_rate),
        reached("byte_rate", c("max_byte_rate"), cfg.vol_byte_rate),
    )
    hits = volumetric_hits(cfg, c("max_syn_rate"), c("max_pkt_rate"), c("max_byte_rate"))
    volume = F.concat(hits.cast("string"), F.lit(" of 3 volumetric: "), parts)
    return (
        F.when(c("abuse_class") == SYN_FLOOD, flood).when(c("abuse_class") == VOLUMETRIC, volume).otherwise("")
    )
