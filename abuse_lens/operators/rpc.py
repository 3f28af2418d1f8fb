"""Request/response pairs and their window features.

Messages: ``flow`` columns, ``direction`` ('to_server'|'from_server'),
``body_len, first_ts, done_ts, status, rpc_parsed, rpc_error_code``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.functions.numbers import fraction
from abuse_lens.operators.slices import PREFIX, lag_in_slices, running_in_slices, with_slice

DISTINCT_CAP = 5


def server_direction(server_ports: list[int] | tuple[int, ...]) -> Column:
    """Direction by server port; a packet between two server ports goes to the server."""
    ports = [int(p) for p in server_ports]
    return F.when(F.col("dst_port").isin(ports), "to_server").when(F.col("src_port").isin(ports), "from_server")


def directed(events: DataFrame, server_ports: list[int] | tuple[int, ...]) -> DataFrame:
    """Keep the events of a server port, with ``direction`` and the two-way flow key."""
    from abuse_lens.functions.net import flow_high, flow_low

    ends = [F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")]
    return (
        events.withColumn("direction", server_direction(server_ports))
        .where(F.col("direction").isNotNull())
        .withColumns({"flow_low": flow_low(*ends), "flow_high": flow_high(*ends)})
    )


def pair_messages(messages: DataFrame, flow: list[str], order: list[str], position: str, width: int) -> DataFrame:
    """A response pairs with the message before it in its flow if that is a request.

    Requests without a response and responses without a request are left out.
    ``position``/``width`` cut long flows into slices.
    """
    carried = ["direction", "body_len", "first_ts"]
    sliced, at = with_slice(messages, position, width)
    lagged = lag_in_slices(sliced, flow, order, at, carried)
    c = F.col
    return lagged.where((c("direction") == "from_server") & (c("prev.direction") == "to_server")).select(
        *flow,
        *[o for o in order if o not in flow],
        c("prev.body_len").alias("request_bytes"),
        c("body_len").alias("response_bytes"),
        c("status").alias("status_code"),
        c("prev.first_ts").alias("req_started_ns"),
        c("done_ts").alias("resp_completed_ns"),
        c("rpc_parsed").alias("rpc_envelope_parsed"),
        c("rpc_error_code"),
        *[k for k in messages.columns if k == "client_port"],
    )


def duration_ns() -> Column:
    """Only a response completed after its request started has a duration."""
    return F.when(
        F.col("resp_completed_ns") > F.col("req_started_ns"), F.col("resp_completed_ns") - F.col("req_started_ns")
    )


def amp_ratio() -> Column:
    return F.when(F.col("request_bytes") > 0, F.col("response_bytes").cast("double") / F.col("request_bytes"))


def window_features(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Everything but the median and the port counts, in one partial aggregate."""
    c = F.col
    d, r = duration_ns(), amp_ratio()
    in_class = lambda lo: F.count_if(c("status_code").between(lo, lo + 99))
    n_status = F.count("status_code")
    n_parsed = F.count_if(c("rpc_envelope_parsed"))
    error = F.when(c("rpc_envelope_parsed"), c("rpc_error_code"))
    timed = F.when(d > 0, d)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("response_bytes").alias("resp_bytes_total"),
        F.max("request_bytes").alias("req_bytes_max"),
        F.max("response_bytes").alias("resp_bytes_max"),
        (F.sum("request_bytes").cast("double") / F.count(F.lit(1))).alias("req_bytes_mean"),
        (F.sum("response_bytes").cast("double") / F.count(F.lit(1))).alias("resp_bytes_mean"),
        F.avg(r).alias("amp_ratio_mean"),
        F.max(r).alias("amp_ratio_max"),
        F.max(d).alias("duration_ns_max"),
        F.when(F.count(timed) > 0, F.call_function("div", F.sum(timed), F.greatest(F.count(timed), F.lit(1)))).alias(
            "duration_ns_mean"
        ),
        fraction(in_class(200), n_status).alias("status_2xx_frac"),
        fraction(in_class(400), n_status).alias("status_4xx_frac"),
        fraction(in_class(500), n_status).alias("status_5xx_frac"),
        F.when(n_parsed > 0, F.least(F.count_distinct(error), F.lit(DISTINCT_CAP))).alias("rpc_error_distinct_codes"),
        F.when(n_parsed > 0, F.count(error).cast("double") / F.count(F.lit(1))).alias("rpc_error_frac"),
    )


def exact_median(values: DataFrame, by: list[str], value: str, into: str) -> DataFrame:
    """Exact median per group without holding a group in memory.

    Equal values are counted first; the counts are then ranked by a running sum
    that is cut into slices of the value's magnitude (1/64 of a power of two).
    Values must not be negative.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    magnitude = F.when(F.col(value) > 0, F.floor(F.log2(value) * 64)).otherwise(F.lit(-(2**40)).cast("bigint"))
    at = f"{PREFIX}{value}"
    sliced = counted.withColumn(at, F.coalesce(magnitude.cast("bigint"), F.lit(0).cast("bigint")))
    keys = [F.coalesce(F.col(b).cast("string"), F.lit("")).alias(f"_k{i}") for i, b in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    ranked = running_in_slices(sliced.select("*", *keys), names, [value], at, {"_to": ("sum", F.col("_n"))})
    totals = counted.groupBy(*by).agg(F.sum("_n").alias("_total"))
    c = F.col
    half = c("_total") % 2
    lower = F.call_function("div", c("_total") + 1, F.lit(2).cast("bigint"))
    upper = lower + 1 - half
    holds = lambda rank: (c("_to") >= rank) & (c("_to") - c("_n") < rank)
    return (
        ranked.join(totals, by)
        .where(holds(lower) | holds(upper))
        .groupBy(*by)
        .agg(((F.min(value) + F.max(value)) / 2.0).alias(into))
    )


def amp_ratio_median(pairs: DataFrame, by: list[str]) -> DataFrame:
    return exact_median(pairs.select(*by, amp_ratio().alias("ratio")), by, "ratio", "amp_ratio_median")


def port_cardinality(events: DataFrame, by: list[str]) -> DataFrame:
    """Distinct server and client side ports over all events, capped at 5."""
    cap = lambda c: F.least(F.count_distinct(c), F.lit(DISTINCT_CAP))
    return events.groupBy(*by).agg(
        cap("dst_port").alias("unique_dst_ports"), cap("src_port").alias("unique_src_ports")
    )


def response_aggregates(pairs: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """All features per window; windows without a pair have no row (their ports too)."""
    return (
        window_features(pairs, by)
        .join(amp_ratio_median(pairs, by), by, "left")
        .join(port_cardinality(events, by), by, "left")
    )


def with_idle_windows(features: DataFrame, window: str, width: int) -> DataFrame:
    """Add a row with nulls for every window between the first and last seen."""
    bounds = features.agg(F.min(window).alias("lo"), F.max(window).alias("hi")).first()
    # a range is made in parallel; one array of all windows would be one task's
    every = features.sparkSession.range(bounds.lo or 0, bounds.hi + 1 if bounds.hi is not None else 0, width)
    return every.withColumnRenamed("id", window).join(features, window, "left")
