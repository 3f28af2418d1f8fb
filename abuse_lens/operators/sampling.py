"""Sampling regimes from a trigger log, and 1-in-N sampling inside them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.operators.slices import (
    lag_in_slices,
    row_number_in_slices,
    running_in_slices,
    with_slice,
    without_slices,
)

TAG_PATTERN = r"^[A-Za-z0-9_-]{1,64}$"
OPEN_END = 2**62


def valid_tag(tag: Column) -> Column:
    return tag.rlike(TAG_PATTERN)


def accepted_commands(log: DataFrame) -> DataFrame:
    """Commands that change the state: rates of at least 1, well-formed tags."""
    c = F.col
    rate_ok = F.coalesce(c("rate") >= 1, F.lit(False))
    return log.where(
        (c("action") == "stop")
        | ((c("action") == "set-sample-rate") & rate_ok)
        | ((c("action") == "trigger") & rate_ok & F.coalesce(valid_tag(c("tag")), F.lit(False)))
    )


def regimes(log: DataFrame, initial_rate: int = 1, slice_sec: int = 86400) -> DataFrame:
    """State intervals ``[start_ts, end_ts)`` between commands and deadlines.

    A trigger starts sampling under its tag, ``stop`` ends it, a rate change
    keeps everything else.  A trigger with a duration ends by itself, even when
    rate changes come in between.  One row per state, ``active`` or not.
    ``seq`` orders the commands of one second.  Nothing is sampled before the
    first command; a log that starts active starts with a trigger.
    """
    c = F.col
    at = ["ts", "seq"]
    commands = accepted_commands(log).select(
        "ts", "seq", "action", "rate", "tag", "duration_sec", F.lit(0).alias("_all"),
        (-c("ts")).alias("_back_ts"), (-c("seq")).alias("_back_seq"),
    )
    # The command after this one: the one before it, read backwards.
    backwards, back_at = with_slice(commands, "_back_ts", slice_sec)
    followed = lag_in_slices(backwards, ["_all"], ["_back_ts", "_back_seq"], back_at, ["ts"], "_next")
    # The last value set so far is the greatest (ts, seq, value).
    last_set = {
        "_rate": F.when(c("action") != "stop", F.struct(*at, "rate")),
        "_switch": F.when(c("action").isin("trigger", "stop"), F.struct(*at, (c("action") == "trigger").alias("on"))),
        "_trigger": F.when(c("action") == "trigger", F.struct(*at, "tag", "duration_sec")),
    }
    forwards, slice_col = with_slice(followed, "ts", slice_sec)
    state = running_in_slices(forwards, ["_all"], at, slice_col, {n: ("max", e) for n, e in last_set.items()})
    spans = state.select(
        c("ts").alias("start_ts"),
        F.coalesce(c("_next.ts"), F.lit(OPEN_END)).alias("next_ts"),
        F.coalesce(c("_rate.rate"), F.lit(initial_rate)).cast("bigint").alias("rate"),
        F.coalesce(c("_switch.on"), F.lit(False)).alias("on"),
        c("_trigger.tag").alias("incident_tag"),
        c("_trigger.ts").alias("trigger_ts"),
        (c("_trigger.ts") + c("_trigger.duration_sec")).alias("deadline_ts"),
    )
    deadline = F.coalesce("deadline_ts", F.lit(OPEN_END))
    sampled_until = F.when(c("on"), F.greatest(F.least("next_ts", deadline), c("start_ts"))).otherwise(c("start_ts"))
    part = lambda s, e, a: F.struct(s.alias("s"), e.alias("e"), F.lit(a).alias("a"))
    return (
        spans.withColumn("until", sampled_until)
        .select(
            "rate",
            "incident_tag",
            "trigger_ts",
            F.explode(
                F.array(part(c("start_ts"), c("until"), True), part(c("until"), c("next_ts"), False))
            ).alias("p"),
        )
        .where(c("p.s") < c("p.e"))
        .select(
            c("p.s").alias("start_ts"), c("p.e").alias("end_ts"), c("p.a").alias("active"),
            "rate", "incident_tag", "trigger_ts",
        )
    )


def in_regime(packets: DataFrame, spans: DataFrame, ts: str = "ts", bucket_sec: int = 3600) -> DataFrame:
    """Join packets with the regime in force at their second.

    Regimes do not overlap.  Both sides get a time bucket, so this is an
    equi-join with a range check inside the bucket and not a loop over all
    regimes; Spark broadcasts the regimes only if their size allows it, and
    splits a bucket that is too full otherwise (skew join).  Regimes are cut to
    the seconds the packets span.
    """
    c = F.col
    width = F.lit(bucket_sec).cast("bigint")
    seen = packets.agg(F.struct(F.min(ts).alias("lo"), F.max(ts).alias("hi"))).scalar()
    start = F.greatest(c("start_ts"), c("_seen.lo"))
    stop = F.least(c("end_ts") - 1, c("_seen.hi"))
    bucket = lambda x: F.call_function("div", x, width)
    cut = (
        spans.withColumn("_seen", seen)
        .where(start <= stop)
        .withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(stop))))
        .drop("_seen")
    )
    return (
        packets.withColumn("_bucket", bucket(c(ts)))
        .join(cut, "_bucket")
        .where((c(ts) >= c("start_ts")) & (c(ts) < c("end_ts")))
        .drop("_bucket")
    )


def one_in_n(
    packets: DataFrame,
    lane: list[str],
    order: list[str],
    position: str,
    width: int,
    rate: Column,
) -> DataFrame:
    """Every ``rate``-th row of a lane (a CPU, or a CPU within one regime).

    The countdown starts at rate - 1, so the rate-th row is the first taken; a
    rate of 1 or less takes all.  Lanes are few and long, so their numbering
    runs in slices of ``position``.
    """
    keys = [F.coalesce(F.col(k).cast("bigint"), F.lit(-1).cast("bigint")).alias(f"_lane{i}") for i, k in enumerate(lane)]
    names = [f"_lane{i}" for i in range(len(lane))]
    sliced, at = with_slice(packets.select("*", *keys), position, width)
    numbered = row_number_in_slices(sliced, names, order, at, "_rn")
    every = F.greatest(rate.cast("bigint"), F.lit(1).cast("bigint"))
    return without_slices(numbered.where(F.pmod(F.col("_rn"), every) == 0).drop("_rn", *names))


def sample_with_carry(
    packets: DataFrame, lane: str, order: list[str], position: str, width: int, initial_rate: int = 1
) -> DataFrame:
    """1-in-N across changing rates with the countdown carried over.

    Only active rows count.  A new rate takes effect at the next reset: the
    countdown a lane is in when the rate changes runs out first.  ``packets``
    carry ``active``, ``rate`` and ``start_ts`` of their regime.  What is
    followed in order is one counted row per (lane, regime), not the packets,
    as a stream of batches.
    """
    c = F.col
    active = packets.where(c("active")).withColumn(
        "_lane", F.coalesce(c(lane).cast("bigint"), F.lit(-1).cast("bigint"))
    )
    per_regime = active.groupBy("_lane", "start_ts").agg(F.max("rate").alias("rate"), F.count(F.lit(1)).alias("n"))
    first = max(initial_rate, 1) - 1

    def countdown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left = None, first
        for rows in batches:
            starting = []
            for one, rate, n in zip(rows["_lane"].tolist(), rows["rate"].tolist(), rows["n"].tolist()):
                if one != at:
                    at, left = one, first
                starting.append(left)
                left = left - n if n <= left else rate - 1 - (n - left - 1) % rate
            yield rows[["_lane", "start_ts"]].assign(left=starting)

    in_order = per_regime.repartition("_lane").sortWithinPartitions("_lane", "start_ts")
    starts = in_order.mapInPandas(countdown, "_lane bigint, start_ts bigint, left bigint")
    sliced, at = with_slice(active, position, width)
    numbered = row_number_in_slices(sliced, ["_lane", "start_ts"], order, at, "_rn")
    due = c("_rn") - c("left") - 1
    placed = numbered.join(starts, ["_lane", "start_ts"])
    return without_slices(placed.where((due >= 0) & (F.pmod(due, c("rate")) == 0)).drop("_rn", "_lane", "left"))
