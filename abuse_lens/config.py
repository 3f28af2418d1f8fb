"""Report and episode parameters (plain values; Catalyst folds them in)."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The defaults every result is compared under.
WINDOW_SEC = 10
SYN_RATE_THRESHOLD = 100.0
SUCCESS_RATIO_THRESHOLD = 0.1
BLOCK_DURATION_SEC = 300
FP_SAFE_RATIO = 0.5
MIN_SAMPLES_FOR_FP = 10
TOP_OFFENDERS = 10
VOL_SYN_RATE = 500.0
VOL_PKT_RATE = 1000.0
VOL_BYTE_RATE = 1_000_000.0
MIN_EPISODE_INTERVALS = 1
RELIABLE_SYN_SAMPLES = 10
DEFAULT_INTERVAL_SEC = 60
MAX_WATCHED_PORTS = 8
RULES_VERSION = 3
REPORT_VERSION = 5
FP_LIMIT_PCT = 5.0
MIN_SYN_IMPACT_PCT = 1.0

SYN_FLOOD = "SYN_FLOOD_LIKE"
VOLUMETRIC = "VOLUMETRIC_TCP_ABUSE"


@dataclass(frozen=True)
class ReportConfig:
    """Thresholds of one report run.

    ``first_appearance`` decides what a key's first snapshot contributes to the
    whole-run totals: ``"baseline"`` (nothing) or ``"raw"`` (its counters).
    ``slice_intervals`` bounds how many intervals of one key a single task
    sorts; longer histories are cut into slices that are stitched together.
    """

    dst_ports: tuple[int, ...] = ()
    window_sec: int = WINDOW_SEC
    syn_rate_threshold: float = SYN_RATE_THRESHOLD
    success_ratio_threshold: float = SUCCESS_RATIO_THRESHOLD
    block_duration_sec: int = BLOCK_DURATION_SEC
    fp_safe_ratio: float = FP_SAFE_RATIO
    min_samples_for_fp: int = MIN_SAMPLES_FOR_FP
    top_offenders: int = TOP_OFFENDERS
    vol_syn_rate: float = VOL_SYN_RATE
    vol_pkt_rate: float = VOL_PKT_RATE
    vol_byte_rate: float = VOL_BYTE_RATE
    min_episode_intervals: int = MIN_EPISODE_INTERVALS
    first_appearance: str = "baseline"
    slice_intervals: int = 1024
    report_title: str = "Abuse Report"

    def __post_init__(self) -> None:
        if self.first_appearance not in ("baseline", "raw"):
            raise ValueError(f"first_appearance must be baseline or raw, got {self.first_appearance!r}")
        if self.slice_intervals < 1:
            raise ValueError("slice_intervals must be positive")

    def with_(self, **changes) -> "ReportConfig":
        return replace(self, **changes)


def watched_ports(ports: list[int] | None, more: list[int] | None = None) -> tuple[int, ...]:
    """Merge the two port options into one sorted set of 1 to 8 ports.

    A port given twice within the options, an empty result, a port outside
    1..65535 or more than eight ports is a configuration error.
    """
    given = list(ports or []) + list(more or [])
    if not given:
        raise ValueError("at least one destination port is needed")
    if len(set(given)) != len(given):
        raise ValueError(f"duplicate destination ports in {given}")
    bad = [p for p in given if not 1 <= p <= 65535]
    if bad:
        raise ValueError(f"ports out of range: {bad}")
    if len(given) > MAX_WATCHED_PORTS:
        raise ValueError(f"at most {MAX_WATCHED_PORTS} ports, got {len(given)}")
    return tuple(sorted(given))
