"""Per-key verdicts, their counterfactual impact and the ranked offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.config import (
    FP_LIMIT_PCT,
    MIN_SYN_IMPACT_PCT,
    RELIABLE_SYN_SAMPLES,
    SYN_FLOOD,
    VOLUMETRIC,
    ReportConfig,
)
from abuse_lens.functions import net
from abuse_lens.functions.numbers import fixed, percent
from abuse_lens.operators.episodes import syn_flood, volumetric_hits
from abuse_lens.sources.allowlist import Allowlist, with_allow_flag

KEY_ORDER = [F.asc, F.asc, F.asc_nulls_first]


def key_order() -> list[Column]:
    """Numeric document order: key type rank, address, port with none first."""
    return [F.col("key_ord").asc(), F.col("ip_u32").asc(), F.col("dst_port").asc_nulls_first()]


def with_abuse(totals: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Whole-run class.

    A SYN flood needs a reliable ratio (10 SYN or more) to come before the
    volume rule; an unreliable one comes after it, with medium confidence.
    """
    c = F.col
    flood = syn_flood(cfg, c("syn_rate"), c("success_ratio"))
    reliable = c("total_syn") >= RELIABLE_SYN_SAMPLES
    hits = volumetric_hits(cfg, c("syn_rate"), c("pkt_rate"), c("byte_rate"))
    return totals.withColumns(
        {
            "volumetric_hits": hits,
            "detected_class": F.when(flood & reliable, SYN_FLOOD).when(hits >= 2, VOLUMETRIC).when(flood, SYN_FLOOD),
            "confidence": F.when(flood & ~reliable, "medium").otherwise("high"),
        }
    )


def decide(totals: DataFrame, cfg: ReportConfig, allow: Allowlist, now: int) -> DataFrame:
    """Block every key with a class unless it is allowlisted."""
    c = F.col
    judged = with_allow_flag(with_abuse(totals, cfg), allow)
    block = ~c("allowlisted") & c("detected_class").isNotNull()
    return judged.withColumns(
        {
            "abuse_class": F.when(block, c("detected_class")),
            "decision": F.when(block, "block").otherwise("allow"),
            "until_ts": F.when(block, F.lit(now + cfg.block_duration_sec).cast("bigint")),
        }
    ).drop("detected_class")


def blocked(decisions: DataFrame) -> DataFrame:
    return decisions.where((F.col("decision") == "block") & ~F.col("allowlisted"))


def non_allowlisted(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("allowlisted"))


def _sum(column: str, when: Column | None = None) -> Column:
    value = F.col(column) if when is None else F.when(when, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))


def counterfactual(decisions: DataFrame, cfg: ReportConfig) -> DataFrame:
    """One row: what blocking would have stopped, and the false-positive bound.

    Only non-allowlisted keys count.  The bound is unknown below
    ``min_samples_for_fp`` keys, else the share of blocked packets whose key
    looks legitimate (``success_ratio >= fp_safe_ratio``).
    """
    c = F.col
    is_blocked = c("decision") == "block"
    legit = is_blocked & (c("success_ratio") >= cfg.fp_safe_ratio)
    sums = non_allowlisted(decisions).agg(
        F.count(F.lit(1)).alias("keys"),
        _sum("total_packets").alias("total_packets"),
        _sum("total_bytes").alias("total_bytes"),
        _sum("total_syn").alias("total_syn"),
        _sum("total_packets", is_blocked).alias("blocked_packets"),
        _sum("total_bytes", is_blocked).alias("blocked_bytes"),
        _sum("total_syn", is_blocked).alias("blocked_syn"),
        _sum("total_packets", legit).alias("fp_packets"),
        F.count_if(is_blocked).alias("blocked_keys"),
    )
    computed = c("keys") >= cfg.min_samples_for_fp
    reason = F.concat(
        F.lit("Insufficient data: "),
        c("keys").cast("string"),
        F.lit(f" keys, need at least {cfg.min_samples_for_fp}"),
    )
    return sums.withColumns(
        {
            "percent_packets_blocked": percent(c("blocked_packets"), c("total_packets")),
            "percent_bytes_blocked": percent(c("blocked_bytes"), c("total_bytes")),
            "percent_syn_blocked": percent(c("blocked_syn"), c("total_syn")),
            "fp_computed": computed,
            "fp_value_pct": F.when(computed, percent(c("fp_packets"), c("blocked_packets"))),
            "fp_reason": F.when(~computed, reason),
        }
    )


def readiness(impact: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Add the gating reasons, in order, and whether none of them holds."""
    c = F.col
    offenders = F.least(c("blocked_keys"), F.lit(cfg.top_offenders).cast("bigint"))
    reasons = F.array_compact(
        F.array(
            F.when(~c("fp_computed"), F.concat(F.lit("False positive bound unknown: "), c("fp_reason"))).when(
                c("fp_value_pct") > FP_LIMIT_PCT,
                F.concat(F.lit("False positive bound too high: "), fixed(c("fp_value_pct"), 1), F.lit("%")),
            ),
            F.when(offenders == 0, F.lit("No abuse pattern detected")),
            F.when(
                (c("percent_syn_blocked") < MIN_SYN_IMPACT_PCT) & (offenders > 0),
                F.lit("Minimal impact (<1% SYN blocked)"),
            ),
            F.when(c("total_packets") == 0, F.lit("No traffic observed")),
        )
    )
    return impact.withColumn("offender_count", offenders).withColumn("reasons", reasons).withColumn(
        "is_safe", F.size("reasons") == 0
    )


def top_offenders(decisions: DataFrame, cfg: ReportConfig) -> DataFrame:
    """The ``top_offenders`` blocked keys with most SYN; ties in key order."""
    return (
        blocked(decisions)
        .orderBy(F.col("total_syn").desc(), *key_order())
        .limit(cfg.top_offenders)
        .select(
            "key_type",
            "key_ord",
            "ip_u32",
            "dst_port",
            F.coalesce("abuse_class", F.lit("UNKNOWN")).alias("abuse_class"),
            "syn_rate",
            "success_ratio",
            F.col("total_packets").alias("would_block_packets"),
            F.col("total_syn").alias("would_block_syn"),
            F.col("total_bytes").alias("would_block_bytes"),
        )
    )


def analysed(decisions: DataFrame) -> DataFrame:
    """How many sources were looked at and how many would be blocked."""
    return decisions.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("decision") == "block").alias("would_be_blocked")
    )


def evidence(decisions: DataFrame) -> DataFrame:
    """One text row per key, allowlisted keys included."""
    c = F.col
    return decisions.select(
        "key_ord",
        "ip_u32",
        "dst_port",
        net.display_key(c("key_type"), c("ip_u32"), c("dst_port")).alias("source"),
        F.coalesce("abuse_class", F.lit("")).alias("abuse_class"),
        fixed(c("syn_rate"), 2).alias("syn_rate"),
        fixed(c("success_ratio"), 4).alias("success_ratio"),
        "decision",
        c("total_packets").alias("packets"),
        c("total_bytes").alias("bytes"),
        c("total_syn").alias("syn"),
    )
