"""Cumulative counters to deltas, interval rates and whole-run totals.

Counter rows: ``ts, base_ts, seq, key_type, key_ord, ip_u32, dst_port`` and the
six counters.  ``seq`` breaks ties between rows of one key at one ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abuse_lens.config import DEFAULT_INTERVAL_SEC, ReportConfig
from abuse_lens.functions.numbers import rate, ratio, saturating_sub
from abuse_lens.operators.slices import lag_in_slices, slice_columns, with_slice
from abuse_lens.schema import COUNTERS, KEY_TYPES

KEY = ["key_ord", "ip_u32", "port_key"]
_NO_PORT = -1


def keyed(counters: DataFrame, by_run: bool = False) -> DataFrame:
    """Counter rows with null-free grouping columns only.

    ``key_type`` and ``dst_port`` follow from the key and are put back by
    :func:`named`; rows without a port share one key.
    """
    none = F.lit(_NO_PORT)
    run = F.coalesce(F.col("run_id"), none.cast("bigint")) if by_run else F.lit(0).cast("bigint")
    return counters.select(
        F.coalesce("key_ord", none).alias("key_ord"),
        F.coalesce("ip_u32", none.cast("bigint")).alias("ip_u32"),
        F.coalesce(F.col("dst_port").cast("int"), none).alias("port_key"),
        run.alias("run_key"),
        "ts",
        "base_ts",
        "seq",
        *COUNTERS,
        *slice_columns(counters),
    )


def named(df: DataFrame) -> DataFrame:
    """Put ``key_type`` and the nullable ``dst_port`` back beside the key."""
    names = F.array(*[F.lit(k) for k in KEY_TYPES])
    return df.withColumns(
        {
            "key_type": F.try_element_at(names, F.col("key_ord") + 1),
            "dst_port": F.when(F.col("port_key") != _NO_PORT, F.col("port_key")),
        }
    )


def with_deltas(
    counters: DataFrame,
    slice_sec: int,
    by_run: bool = False,
) -> DataFrame:
    """Add ``first`` and ``d_<counter>``, the growth since the key's previous row.

    A counter that shrank grew by 0.  On a key's first row (``first``) the
    deltas are null; what that row counts for is decided by the caller.
    ``by_run`` keeps the chains of several runs apart (``run_key`` column).
    """
    keys = [*KEY, "run_key"]
    sliced, at = with_slice(keyed(counters, by_run), "ts", slice_sec)
    lagged = lag_in_slices(sliced, keys, ["ts", "seq"], at, list(COUNTERS))
    return lagged.withColumns(
        {
            "first": F.col("prev").isNull(),
            **{f"d_{c}": saturating_sub(F.col(c), F.col(f"prev.{c}")) for c in COUNTERS},
        }
    ).drop("prev")


def run_totals(deltas: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Whole-run totals and rates per key.

    With ``first_appearance="baseline"`` a first row only sets the baseline, so
    a key seen once has no totals; with ``"raw"`` its counters count in full.
    Rates divide by ``window_sec``, whatever the length of the run.
    """
    if cfg.first_appearance == "baseline":
        deltas = deltas.where(~F.col("first"))
        grown: dict[str, Column] = {c: F.col(f"d_{c}") for c in COUNTERS}
    else:
        grown = {c: F.coalesce(F.col(f"d_{c}"), F.col(c)) for c in COUNTERS}
    return _with_rates(deltas.groupBy(*KEY).agg(*[F.sum(grown[c]).alias(f"total_{c}") for c in COUNTERS]), cfg)


def totals_of_counters(counters: DataFrame, cfg: ReportConfig, slice_sec: int, by_run: bool = False) -> DataFrame:
    """:func:`run_totals` straight from counter rows.

    Totals need no delta per row: each slice adds up its own growth and keeps
    its first and last row, and only those go to the key.  One shuffle of the
    counters, one of the slices, no join.
    """
    keys = [*KEY, "run_key"]
    sliced, slice_col = with_slice(keyed(counters, by_run), "ts", slice_sec)
    cut = [*keys, slice_col]
    by_slice = Window.partitionBy(*cut).orderBy("ts", "seq")
    before = sliced.select("*", *[F.lag(c).over(by_slice).alias(f"_p_{c}") for c in COUNTERS])
    at, row = F.struct("ts", "seq"), F.struct(*COUNTERS)
    slices = before.groupBy(*cut).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(saturating_sub(F.col(c), F.col(f"_p_{c}"))).alias(f"_in_{c}") for c in COUNTERS],
        F.min_by(row, at).alias("_first"),
        F.max_by(row, at).alias("_last"),
    )
    linked = slices.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy(slice_col)))
    starts = F.col("_prev").isNull()
    zero = F.lit(0).cast("bigint")

    def growth(c: str) -> Column:
        opening = F.col(f"_first.{c}") if cfg.first_appearance == "raw" else zero
        entered = F.when(starts, opening).otherwise(saturating_sub(F.col(f"_first.{c}"), F.col(f"_prev.{c}")))
        return F.coalesce(F.col(f"_in_{c}"), zero) + entered

    totals = linked.groupBy(*KEY).agg(
        *[F.sum(growth(c)).alias(f"total_{c}") for c in COUNTERS],
        (F.sum("_rows") - F.count_if(starts)).alias("_grown"),
    )
    if cfg.first_appearance == "baseline":
        totals = totals.where(F.col("_grown") > 0)
    return _with_rates(totals.drop("_grown"), cfg)


def _with_rates(totals: DataFrame, cfg: ReportConfig) -> DataFrame:
    return named(totals).drop("port_key").withColumns(
        {
            "syn_rate": rate(F.col("total_syn"), cfg.window_sec),
            "pkt_rate": rate(F.col("total_packets"), cfg.window_sec),
            "byte_rate": rate(F.col("total_bytes"), cfg.window_sec),
            "success_ratio": ratio(F.col("total_handshake_ack"), F.col("total_syn")),
        }
    )


def interval_stats(deltas: DataFrame, cfg: ReportConfig, interval_sec: int = DEFAULT_INTERVAL_SEC) -> DataFrame:
    """Per-key, per-interval growth with rates.

    A first row counts only in the run's very first snapshot (``base_ts = ts``),
    in full and over ``window_sec``; any other first row sets the baseline.
    """
    at_start = F.col("base_ts").eqNullSafe(F.col("ts"))
    used = deltas.where(~F.col("first") | at_start)
    kept = slice_columns(deltas)
    per = F.when(F.col("first"), F.lit(cfg.window_sec)).otherwise(F.lit(interval_sec))
    grown = {c: F.coalesce(F.col(f"d_{c}"), F.col(c)) for c in COUNTERS}
    return used.select(
        *KEY, "run_key", "ts", "seq", *kept, per.alias("_per"), *[grown[c].alias(c) for c in COUNTERS]
    ).select(
        *KEY,
        "run_key",
        "ts",
        "seq",
        *kept,
        *COUNTERS,
        rate(F.col("syn"), F.col("_per")).alias("syn_rate"),
        rate(F.col("packets"), F.col("_per")).alias("pkt_rate"),
        rate(F.col("bytes"), F.col("_per")).alias("byte_rate"),
        ratio(F.col("handshake_ack"), F.col("syn")).alias("success_ratio"),
    )
