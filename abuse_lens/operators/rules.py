"""Candidate rules and the rates shown beside offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.config import ReportConfig
from abuse_lens.functions import net
from abuse_lens.sources.allowlist import Allowlist, with_allow_flag


def rule_order() -> list[Column]:
    """Rules are ordered by the text of their key, then port with none first."""
    return [F.col("key_type").asc(), F.col("key_value").asc(), F.col("dst_port").asc_nulls_first()]


def episode_order() -> list[Column]:
    return [F.col("start_ts").asc(), F.col("src_ip").asc(), F.col("dst_port").asc_nulls_first()]


def first_episodes(episodes: DataFrame) -> DataFrame:
    """First episode of every (source text, port).

    ``min_by`` keeps one candidate per key and task, so a source with any
    number of episodes never gathers in one place.
    """
    rest = [c for c in episodes.columns if c not in ("src_ip", "dst_port")]
    first = F.min_by(F.struct(*rest), F.struct("start_ts", "key_ord"))
    return episodes.groupBy("src_ip", "dst_port").agg(first.alias("_first")).select("src_ip", "dst_port", "_first.*")


def _rule(cfg: ReportConfig, df: DataFrame, key_type: Column, key_value: Column) -> DataFrame:
    return df.select(
        key_type.alias("key_type"),
        key_value.alias("key_value"),
        "dst_port",
        F.coalesce("abuse_class", F.lit("UNKNOWN")).alias("abuse_class"),
        F.lit(cfg.window_sec).cast("bigint").alias("window_sec"),
        F.lit(float(cfg.syn_rate_threshold)).alias("syn_rate_threshold"),
        F.lit(float(cfg.success_ratio_threshold)).alias("success_ratio_threshold"),
        F.lit("drop").alias("action_type"),
        F.lit(cfg.block_duration_sec).cast("bigint").alias("duration_sec"),
        (F.col("key_ord") == 1).alias("from_cidr24"),
    )


def rules_from_episodes(episodes: DataFrame, cfg: ReportConfig, allow: Allowlist) -> DataFrame:
    """One rule per (source, port) with an episode, allowlisted sources left out.

    The key is always written as ``src_ip``, also for a /24 source (flagged in
    ``from_cidr24``).
    """
    open_to_rules = with_allow_flag(episodes, allow).where(~F.col("allowlisted")).drop("allowlisted")
    return _rule(cfg, first_episodes(open_to_rules), F.lit("src_ip"), F.col("src_ip"))


def rules_from_offenders(offenders: DataFrame, cfg: ReportConfig) -> DataFrame:
    """The older variant: one rule per ranked offender."""
    text = net.long_to_ipv4(F.col("ip_u32"))
    value = F.when(F.col("key_type") == "src_cidr24", F.concat(text, F.lit("/24"))).otherwise(text)
    return _rule(cfg, offenders, F.col("key_type"), value)


def offender_rates(offenders: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rates shown for offenders: those of their first episode, else their own.

    Offenders are a bounded top list, so they are the side that is small.  A
    /24 offender is looked up under its display text and so never matches.
    """
    shown = net.display_key(F.col("key_type"), F.col("ip_u32"), F.col("dst_port"))
    first = first_episodes(episodes).select(
        F.col("src_ip").alias("_src"),
        F.coalesce("dst_port", F.lit(-1)).alias("_port"),
        F.col("max_syn_rate").alias("_syn_rate"),
        F.col("min_success_ratio").alias("_ratio"),
    )
    wanted = offenders.withColumns(
        {
            "source": shown,
            "_src": F.substring_index(shown, ":", 1),
            "_port": F.coalesce("dst_port", F.lit(-1)),
        }
    )
    return (
        wanted.join(first, ["_src", "_port"], "left")
        .withColumns(
            {
                "shown_syn_rate": F.coalesce("_syn_rate", "syn_rate"),
                "shown_success_ratio": F.coalesce("_ratio", "success_ratio"),
            }
        )
        .drop("_src", "_port", "_syn_rate", "_ratio")
    )
