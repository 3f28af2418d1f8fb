"""Deltas and episodes of a counter stream, with state per key.

State of a key: its last counters and its open hot run.  Rows are taken in the
order of the batch operators (time, then position in their source), see
:mod:`abuse_lens.streaming.ordered`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abuse_lens.config import DEFAULT_INTERVAL_SEC, ReportConfig
from abuse_lens.functions import net
from abuse_lens.operators.deltas import keyed, named
from abuse_lens.operators.episodes import episode_class
from abuse_lens.schema import COUNTERS
from abuse_lens.streaming.ordered import SLOT_MS, in_order

KEY = ["key_ord", "ip_u32", "port_key"]
FIELDS = ["ts", "seq", "base_ts", *COUNTERS]
#: A key that is silent for so long is forgotten; its next row is a first one again.
FORGET_SEC = 7 * 86_400
_RUN = (
    "start_ts bigint, end_ts bigint, interval_count bigint, max_syn_rate double, max_pkt_rate double, "
    "max_byte_rate double, min_success_ratio double, total_syn bigint, total_packets bigint, total_bytes bigint"
)
_OUT = "key_ord int, ip_u32 bigint, port_key int, " + _RUN
_INTERVAL_OUT = (
    "key_ord int, ip_u32 bigint, port_key int, ts bigint, first boolean, " + ", ".join(f"d_{c} bigint" for c in COUNTERS)
)


def _stamped(counters: DataFrame, lateness: str) -> DataFrame:
    return keyed(counters).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness)


def _time_ms(row: list) -> int:
    return row[0] * 1000


def stream_deltas(
    counters: DataFrame, lateness: str = "0 seconds", forget_sec: int = FORGET_SEC, slot_sec: int = SLOT_MS // 1000
) -> DataFrame:
    """Growth of every counter row against its key's row before, once the watermark has passed it."""

    def take(key, own, rows):
        before, out = own[0] if own else None, []
        for row in rows:
            now = row[3:]
            grown = [None] * len(now) if before is None else [max(a - b, 0) for a, b in zip(now, before, strict=True)]
            out.append((*key, row[0], before is None, *grown))
            before = now
        return (list(before),), out

    return in_order(
        _stamped(counters, lateness), KEY, FIELDS, 2, _time_ms, take, lambda key, own: [], forget_sec * 1000,
        _INTERVAL_OUT, "counters array<bigint>", slot_sec * 1000,
    )


def _hot(cfg: ReportConfig, syn: float, pkt: float, byte: float, ratio: float) -> bool:
    volume = (syn >= cfg.vol_syn_rate) + (pkt >= cfg.vol_pkt_rate) + (byte >= cfg.vol_byte_rate)
    return (syn >= cfg.syn_rate_threshold and ratio <= cfg.success_ratio_threshold) or volume >= 2


def stream_episodes(
    counters: DataFrame,
    cfg: ReportConfig,
    interval_sec: int = DEFAULT_INTERVAL_SEC,
    lateness: str = "0 seconds",
    idle_intervals: int = 10,
    slot_sec: int = SLOT_MS // 1000,
) -> DataFrame:
    """Episodes of a stream of counter rows, emitted as they close.

    A key silent for ``idle_intervals`` behind the watermark has its run closed and
    is forgotten.
    """

    def ended(key, run) -> list[tuple]:
        return [(*key, *run)] if run is not None and run[2] >= cfg.min_episode_intervals else []

    def step(key, before, run, row):
        ts, now = row[0], list(row[3:])
        if before is None and row[2] != ts:
            return now, run, []
        per = cfg.window_sec if before is None else interval_sec
        syn, _, done, _, pkts, size = now if before is None else [max(a - b, 0) for a, b in zip(now, before, strict=True)]
        rates = [x / per if per > 0 else 0.0 for x in (syn, pkts, size)]
        ratio = done / syn if syn > 0 else 0.0
        if not _hot(cfg, *rates, ratio):
            return now, None, ended(key, run)
        low = ratio if syn > 0 else None
        if run is None:
            return now, (ts, ts, 1, *rates, low, syn, pkts, size), []
        highest = [max(a, b) for a, b in zip(run[3:6], rates, strict=True)]
        lows = [x for x in (run[6], low) if x is not None]
        sums = [a + b for a, b in zip(run[7:], (syn, pkts, size), strict=True)]
        return now, (run[0], ts, run[2] + 1, *highest, min(lows, default=None), *sums), []

    def take(key, own, rows):
        before, run = own or (None, None)
        out = []
        for row in rows:
            before, run, closed = step(key, before, tuple(run) if run is not None else None, row)
            out += closed
        return (before, run), out

    state = f"counters array<bigint>, run struct<{_RUN.replace(' ', ':').replace(',:', ',')}>"
    runs = in_order(
        _stamped(counters, lateness), KEY, FIELDS, 2, _time_ms, take,
        lambda key, own: ended(key, own[1]), idle_intervals * interval_sec * 1000, _OUT, state, slot_sec * 1000,
    )
    return named(runs).withColumns(
        {
            "min_success_ratio": F.coalesce("min_success_ratio", F.lit(0.0)),
            "src_ip": net.long_to_ipv4(F.col("ip_u32")),
            "duration_sec": F.col("end_ts") - F.col("start_ts") + F.lit(interval_sec).cast("bigint"),
            "interval_sec": F.lit(interval_sec).cast("bigint"),
            "episode_type": F.when(F.col("interval_count") == 1, "single_window").otherwise("multi_window"),
        }
    ).withColumn("abuse_class", episode_class(cfg)).drop("port_key")
