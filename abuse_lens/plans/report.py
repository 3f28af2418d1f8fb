"""Snapshot lines to decisions, episodes, rules and impact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from abuse_lens.config import ReportConfig
from abuse_lens.operators import decisions as dec
from abuse_lens.operators import deltas, rules
from abuse_lens.operators import episodes as eps
from abuse_lens.plans.settle import settle
from abuse_lens.sources import snapshots
from abuse_lens.sources.allowlist import Allowlist


@dataclass(frozen=True)
class Report:
    """Tables of one run; ``header``, ``impact`` and ``offenders`` are bounded rows."""

    cfg: ReportConfig
    now: int
    allow: Allowlist
    header: Row
    decisions: DataFrame
    episodes: DataFrame
    rules: DataFrame
    impact: Row
    offenders: list[Row]
    has_single_window: bool

    @property
    def enforcement_reasons(self) -> list[str]:
        """Reasons of the summary: those of the report plus the single-window gate."""
        extra = ["Single-window episode requires manual review"] if self.has_single_window else []
        return [*self.impact["reasons"], *extra]


class NoSnapshots(ValueError):
    pass


class NoPorts(ValueError):
    pass


def build(snapshot_rows: DataFrame, cfg: ReportConfig, allow: Allowlist, now: int, by_run: bool = False) -> Report:
    """Run the report over parsed snapshot rows.

    Ports are taken from the configuration, else from the data; they label the
    documents and filter nothing.  The parsed lines, the decisions and the
    episodes have several readers each, so they are written once; the lines
    as a row per bucket, so that no reader holds the buckets of a line.
    """
    flat = settle(snapshots.flattened(snapshot_rows))  # JSON is parsed once
    header = snapshots.header_of(flat).first()
    if header["start_ts"] is None:
        raise NoSnapshots("no usable snapshots")
    if not cfg.dst_ports:
        if not header["ports"]:
            raise NoPorts("no destination ports in the snapshots or the configuration")
        cfg = cfg.with_(dst_ports=tuple(header["ports"]))
    interval = header["interval_sec"]
    slice_sec = cfg.slice_intervals * max(interval, 1)
    counters = snapshots.counters_of(flat)
    totals = deltas.totals_of_counters(counters, cfg, slice_sec, by_run)
    decided = settle(dec.decide(totals, cfg, allow, now))
    intervals = deltas.interval_stats(deltas.with_deltas(counters, slice_sec, by_run), cfg, interval)
    found = settle(eps.detect_episodes(intervals, cfg, interval))
    ruled = settle(rules.rules_from_episodes(found, cfg, allow))
    impact = dec.readiness(dec.counterfactual(decided, cfg), cfg).first()
    offenders = rules.offender_rates(dec.top_offenders(decided, cfg), found)
    ranked = offenders.orderBy(F.col("would_block_syn").desc(), *dec.key_order()).collect()
    single = found.agg(F.max((F.col("episode_type") == "single_window").cast("int"))).first()[0]
    return Report(cfg, now, allow, header, decided, found, ruled, impact, ranked, bool(single))


def from_directory(
    spark: SparkSession, directory: str, cfg: ReportConfig, allow: Allowlist, now: int, by_run: bool = False
) -> Report:
    return build(snapshots.parse(snapshots.read_lines(spark, directory)).good, cfg, allow, now, by_run)
