"""The registered queries: every operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abuse_lens.functions import hashing, net, numbers, timetext
from abuse_lens.operators import (
    compare,
    decisions,
    deltas,
    episodes,
    host,
    packets,
    quality,
    rpc,
    rules,
    sampling,
    scrub,
)
from abuse_lens.sources import allowlist
from abuse_lens.workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = 1_706_745_600
DAY_NS = t.DAY * 1_000_000_000
HOUR_NS = 3_600_000_000_000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def div(a, b):
    b = b if not isinstance(b, int) else F.lit(b).cast("bigint")
    return F.call_function("div", a, b)


def allow(spark: SparkSession) -> allowlist.Allowlist:
    return allowlist.from_lines(spark, t.ALLOW_LINES)


def intervals_of(spark, sf, cfg=t.EPISODE_CFG):
    return deltas.interval_stats(t.delta_table(spark, sf), cfg, t.DAY)


def episodes_of(spark, sf, cfg=t.EPISODE_CFG):
    return episodes.detect_episodes(intervals_of(spark, sf, cfg), cfg, t.DAY)


def totals_of(spark, sf, cfg=t.CFG):
    return deltas.totals_of_counters(t.cumulative_counters(spark, sf), cfg, t.SLICE_DAYS * t.DAY)


def decisions_of(spark, sf, cfg=t.CFG):
    return decisions.decide(totals_of(spark, sf, cfg), cfg, allow(spark), NOW)


# -- packets and counters ---------------------------------------------------


@query
def q_packet_counters(spark, sf):
    return packets.ingress_counters(packets.watched(t.packet_table(spark, sf), t.PORTS))


@query
def q_packet_counters_egress(spark, sf):
    return packets.egress_counters(packets.watched(t.packet_table(spark, sf), t.PORTS))


@query
def q_packet_counters_both(spark, sf):
    return packets.both_counters(packets.watched(t.packet_table(spark, sf), t.PORTS))


@query
def q_port_filter(spark, sf):
    kept = packets.watched(t.packet_table(spark, sf), [t.PORTS[0]])
    return kept.groupBy("direction").agg(F.count(F.lit(1)).alias("packets"), F.sum("wire_len").alias("bytes"))


@query
def q_handshake_ack(spark, sf):
    return t.packet_table(spark, sf).groupBy("direction", "cpu").agg(
        F.count_if(packets.handshake_ack()).alias("handshake_acks"), F.count_if("ack").alias("acks")
    )


@query
def q_snap_length(spark, sf):
    frames = packets.snapped(t.frame_table(spark, sf))
    return frames.groupBy("cap_len").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.length("pkt")).alias("captured"))


@query
def q_wall_clock(spark, sf):
    anchor = packets.boot_anchor_ns(5_000_000_000, 1_704_100_000_000_000_000)
    return packets.wall_clock(t.packet_table(spark, sf), anchor).select("event_id", "sec", "usec")


@query
def q_cumulative(spark, sf):
    from abuse_lens.schema import COUNTERS

    return t.cumulative_counters(spark, sf).select("ts", "ip_u32", "dst_port", *COUNTERS)


@query
def q_snapshot_assembly(spark, sf):
    rows = packets.assemble_snapshots(t.cumulative_counters(spark, sf), t.PORTS, t.DAY, 7, 1_704_067_200)
    return packets.snapshot_json(rows)


@query
def q_heartbeats(spark, sf):
    rows = packets.assemble_snapshots(t.cumulative_counters(spark, sf), t.PORTS, t.DAY, 7, 1_704_067_200)
    return quality.heartbeats(rows)


@query
def q_collection_result(spark, sf):
    rows = packets.assemble_snapshots(t.cumulative_counters(spark, sf), t.PORTS, t.DAY, 7, 1_704_067_200)
    return quality.collection_result(rows)


@query
def q_collection_result_parts(spark, sf):
    """Snapshots written in seven parts each count as often as whole ones."""
    rows = packets.assemble_snapshots(t.cumulative_counters(spark, sf), t.PORTS, t.DAY, 7, 1_704_067_200, parts=7)
    return quality.collection_result(rows)


@query
def q_heartbeats_parts(spark, sf):
    rows = packets.assemble_snapshots(t.cumulative_counters(spark, sf), t.PORTS, t.DAY, 7, 1_704_067_200, parts=7)
    return quality.heartbeats(rows)


# -- deltas, rates, episodes ------------------------------------------------


@query
def q_deltas(spark, sf):
    d = deltas.named(t.delta_table(spark, sf))
    return d.select("ts", "ip_u32", "dst_port", "first", *[f"d_{c}" for c in ("syn", "ack", "handshake_ack", "rst", "packets", "bytes")])


TOTALS = ["ip_u32", "dst_port", "total_syn", "total_ack", "total_rst", "total_packets", "total_bytes", "syn_rate", "success_ratio"]


@query
def q_totals_raw(spark, sf):
    return totals_of(spark, sf, t.CFG.with_(first_appearance="raw")).select(*TOTALS)


@query
def q_totals_baseline(spark, sf):
    return totals_of(spark, sf).select(*TOTALS)


@query
def q_totals_from_deltas(spark, sf):
    return deltas.run_totals(t.delta_table(spark, sf), t.CFG).select(*TOTALS)


@query
def q_interval_stats(spark, sf):
    rates = ["syn_rate", "pkt_rate", "byte_rate", "success_ratio"]
    counts = ["syn", "ack", "handshake_ack", "rst", "packets", "bytes"]
    return deltas.named(intervals_of(spark, sf)).select("ts", "ip_u32", "dst_port", *counts, *rates)


@query
def q_hot_intervals(spark, sf):
    hot = deltas.named(intervals_of(spark, sf)).withColumn("hot", episodes.is_hot(t.EPISODE_CFG))
    return hot.where("hot").select("ts", "ip_u32", "dst_port", "syn_rate", "success_ratio")


EPISODE = [
    "src_ip", "dst_port", "start_ts", "end_ts", "duration_sec", "interval_count", "interval_sec", "episode_type",
    "max_syn_rate", "max_pkt_rate", "max_byte_rate", "min_success_ratio", "total_syn", "total_packets", "total_bytes",
    "abuse_class",
]


@query
def q_episodes(spark, sf):
    return episodes_of(spark, sf).select(*EPISODE)


@query
def q_episode_reasons(spark, sf):
    ep = episodes_of(spark, sf, PER_DAY)
    return ep.select("src_ip", "dst_port", "start_ts", episodes.trigger_reason(PER_DAY).alias("trigger_reason"))


# Rates per interval instead of per second, so that their text shows digits.
PER_DAY = t.EPISODE_CFG.with_(syn_rate_threshold=2 / t.DAY, success_ratio_threshold=0.5, vol_syn_rate=1 / t.DAY)


@query
def q_long_episodes(spark, sf):
    cfg = t.EPISODE_CFG.with_(min_episode_intervals=2)
    return episodes_of(spark, sf, cfg).select(*EPISODE)


# -- verdicts and impact ----------------------------------------------------


@query
def q_abuse_class(spark, sf):
    judged = decisions.with_abuse(totals_of(spark, sf), t.CFG)
    return judged.select("ip_u32", "dst_port", "volumetric_hits", "detected_class", "confidence")


@query
def q_decisions(spark, sf):
    return decisions_of(spark, sf).select(
        "ip_u32", "dst_port", "allowlisted", "abuse_class", "confidence", "decision", "until_ts"
    )


@query
def q_blocked_keys(spark, sf):
    return decisions.blocked(decisions_of(spark, sf)).select("ip_u32", "dst_port", "total_syn", "until_ts")


@query
def q_non_allowlisted_keys(spark, sf):
    return decisions.non_allowlisted(decisions_of(spark, sf)).select("ip_u32", "dst_port", "decision")


@query
def q_allowlist_join(spark, sf):
    listed = allow(spark)
    keys = packets.both_counters(t.packet_table(spark, sf)).select("ip_u32", "dst_port", "packets")
    return allowlist.with_allow_flag(keys, listed)


@query
def q_counterfactual(spark, sf):
    return decisions.counterfactual(decisions_of(spark, sf), t.CFG).select(
        "total_packets", "total_bytes", "total_syn", "blocked_packets", "blocked_bytes", "blocked_syn",
        "percent_packets_blocked", "percent_bytes_blocked", "percent_syn_blocked",
    )


@query
def q_fp_bound(spark, sf):
    return decisions.counterfactual(decisions_of(spark, sf), t.CFG).select("fp_computed", "fp_value_pct", "fp_reason")


@query
def q_fp_bound_unknown(spark, sf):
    cfg = t.CFG.with_(min_samples_for_fp=10**9)
    return decisions.counterfactual(decisions_of(spark, sf), cfg).select("fp_computed", "fp_value_pct", "fp_reason")


@query
def q_top_offenders(spark, sf):
    top = decisions.top_offenders(decisions_of(spark, sf), t.CFG)
    return top.select(
        "ip_u32", "dst_port", "abuse_class", "syn_rate", "success_ratio",
        "would_block_packets", "would_block_syn", "would_block_bytes",
    )


@query
def q_analysed(spark, sf):
    return decisions.analysed(decisions_of(spark, sf))


@query
def q_readiness(spark, sf):
    ready = decisions.readiness(decisions.counterfactual(decisions_of(spark, sf), t.CFG), t.CFG)
    return ready.select(F.concat_ws("|", "reasons").alias("reasons"), "is_safe", "offender_count")


@query
def q_evidence(spark, sf):
    return decisions.evidence(decisions_of(spark, sf)).drop("key_ord", "ip_u32", "dst_port")


# -- rules ------------------------------------------------------------------

RULE = [
    "key_type", "key_value", "dst_port", "abuse_class", "window_sec", "syn_rate_threshold", "success_ratio_threshold",
    "action_type", "duration_sec",
]


@query
def q_rules(spark, sf):
    return rules.rules_from_episodes(episodes_of(spark, sf), t.EPISODE_CFG, allow(spark)).select(*RULE)


@query
def q_rules_from_offenders(spark, sf):
    top = decisions.top_offenders(decisions_of(spark, sf), t.CFG)
    return rules.rules_from_offenders(top, t.CFG).select(*RULE)


@query
def q_exceptions(spark, sf):
    """Allowlist entries that some observed source falls under, as exceptions."""
    seen = t.packet_table(spark, sf).select(F.when(F.col("direction") == "egress", F.col("dst_ip")).otherwise(F.col("src_ip")).alias("ip")).distinct()
    lines = seen.select(F.concat(net.long_to_ipv4(net.cidr_network(F.col("ip"), F.lit(28))), F.lit("/28")).alias("value")).union(
        seen.where(F.col("ip") % 7 == 0).select(net.long_to_ipv4(F.col("ip")).alias("value"))
    )
    table = allowlist.parse_lines(lines.distinct())
    listed = allowlist.Allowlist(table, (28, 32), 0, 0)
    return allowlist.exceptions(listed).select("rank", "network", "prefix_len", "key_type", "key_value")


@query
def q_offender_rates(spark, sf):
    top = decisions.top_offenders(decisions_of(spark, sf), t.CFG)
    shown = rules.offender_rates(top, episodes_of(spark, sf, t.CFG))
    return shown.select("source", "shown_syn_rate", "shown_success_ratio", "would_block_packets", "would_block_syn")


@query
def q_single_window_gate(spark, sf):
    ep = episodes_of(spark, sf)
    return ep.agg(
        F.coalesce(F.max(F.col("episode_type") == "single_window"), F.lit(False)).alias("has_single_window"),
        F.count(F.lit(1)).alias("episodes"),
        F.count("abuse_class").alias("triggers"),
    )


@query
def q_run_header(spark, sf):
    from abuse_lens.sources import snapshots

    rows = packets.assemble_snapshots(t.cumulative_counters(spark, sf), t.PORTS, t.DAY, 7, 1_704_067_200)
    lines = packets.snapshot_json(rows).select("value")
    header = snapshots.run_header(snapshots.parse(lines).good)
    return header.withColumn("ports", F.concat_ws(",", "ports"))


@query
def q_snapshot_roundtrip(spark, sf):
    """Counters to JSON lines, parsed and flattened again."""
    from abuse_lens.sources import snapshots

    rows = packets.assemble_snapshots(t.cumulative_counters(spark, sf), t.PORTS, t.DAY, 7, 1_704_067_200, parts=7)
    counters = snapshots.counter_rows(snapshots.parse(packets.snapshot_json(rows).select("value")).good)
    return counters.select("ts", "key_type", "ip_u32", "dst_port", "syn", "packets", "bytes")


@query
def q_bad_lines(spark, sf):
    """Quarantine of every kind of unusable snapshot line, made from all events."""
    from abuse_lens.sources import snapshots

    judged = snapshots.parse(t.snapshot_lines_with_faults(spark, sf)).judged
    return judged.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


@query
def q_bad_lines_located(spark, sf):
    """File and line of every unusable snapshot line, out of one file a day."""
    import uuid

    from abuse_lens.plans.settle import shared_folder
    from abuse_lens.sources import snapshots

    hour = timetext.hour_name(div(t.micros_from_ntz(F.col("ts")), t.DAY * 1_000_000) * t.DAY).alias("hour")
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    written = t.snapshot_lines_with_faults(spark, sf, hour, F.col("event_id"))
    written.repartition("hour").sortWithinPartitions("hour", "event_id").drop("event_id").write.partitionBy("hour").text(folder)
    lines = snapshots.read_lines(spark, folder, places=True)
    return snapshots.located(snapshots.parse(lines).bad, lines).select("file_name", "line", "reason")


@query
def q_time_slice(spark, sf):
    from abuse_lens.sources import snapshots

    lo, hi = 1_704_067_200 + 3 * t.DAY, 1_704_067_200 + 9 * t.DAY
    rows = snapshots.between(t.cumulative_counters(spark, sf), lo, hi, "ts")
    return rows.groupBy("ts").agg(F.count(F.lit(1)).alias("keys"), F.sum("packets").alias("packets"))


# -- pairs and window features ------------------------------------------------


def pairs_of(spark, sf):
    return rpc.pair_messages(t.message_table(spark, sf), ["flow"], ["turn"], "turn", 4)


def windowed_pairs(spark, sf):
    return pairs_of(spark, sf).withColumn("window", div(F.col("flow"), 10))


@query
def q_rpc_pairs(spark, sf):
    return pairs_of(spark, sf).drop("client_port")


@query
def q_window_features(spark, sf):
    features = rpc.window_features(windowed_pairs(spark, sf), ["window"])
    return features.select(
        "window", "count", "resp_bytes_total", "req_bytes_max", "resp_bytes_max", "req_bytes_mean", "resp_bytes_mean",
        F.round("amp_ratio_mean", 9).alias("amp_ratio_mean"), "amp_ratio_max", "duration_ns_max", "duration_ns_mean",
    )


@query
def q_amp_median(spark, sf):
    return rpc.amp_ratio_median(windowed_pairs(spark, sf), ["window"])


@query
def q_status_fracs(spark, sf):
    features = rpc.window_features(windowed_pairs(spark, sf), ["window"])
    return features.select("window", "status_2xx_frac", "status_4xx_frac", "status_5xx_frac")


@query
def q_rpc_errors(spark, sf):
    features = rpc.window_features(windowed_pairs(spark, sf), ["window"])
    return features.select("window", "rpc_error_distinct_codes", "rpc_error_frac")


def directed_packets(spark, sf):
    seen = t.packet_table(spark, sf).withColumnRenamed("direction", "side")
    return rpc.directed(seen, t.PORTS)


@query
def q_port_cardinality(spark, sf):
    windows = directed_packets(spark, sf).withColumn("window", div(F.col("ts_ns"), DAY_NS))
    return rpc.port_cardinality(windows, ["window"])


@query
def q_flow_key(spark, sf):
    flows = directed_packets(spark, sf).groupBy("flow_low", "flow_high")
    return flows.agg(F.count(F.lit(1)).alias("packets"), F.sum("wire_len").alias("bytes"))


@query
def q_direction(spark, sf):
    marked = t.packet_table(spark, sf).select(rpc.server_direction([8000, 40001, 40002]).alias("to"))
    return marked.groupBy(F.coalesce("to", F.lit("dropped")).alias("direction")).agg(F.count(F.lit(1)).alias("packets"))


@query
def q_idle_windows(spark, sf):
    """Packet windows of a minute with a row for minutes without any packet."""
    minutes = t.packet_table(spark, sf).withColumn("minute", div(F.col("ts_ns"), 60_000_000_000))
    counted = minutes.groupBy("minute").agg(F.count(F.lit(1)).alias("packets"), F.sum("wire_len").alias("bytes"))
    return rpc.with_idle_windows(counted, "minute", 1)


# -- host, scrub, sampling ----------------------------------------------------


@query
def q_host_delta(spark, sf):
    d = host.host_deltas(t.host_samples(spark, sf))
    r6 = lambda c: F.round(c, 6).alias(c)
    return d.select(
        "pid", timetext.micros_from_ntz(F.col("captured_at")).alias("captured_us"), r6("cpu_mean"), r6("cpu_max"), "rss_delta", "rss_max", r6("rss_slope_bps"),
        "num_fds_delta", "num_connections_delta", "num_connections_max", "io_write_delta",
    )


@query
def q_scrub_drop(spark, sf):
    kept = scrub.scrub_addresses(t.packet_table(spark, sf), subnet="0.0.0.0/1")
    internal = t.packet_table(spark, sf).where(scrub.internal(F.col("src_ip"), F.col("dst_ip"), "8.0.0.0/5") | scrub.internal(F.col("src_ip"), F.col("dst_ip"), "192.168.1.0/0"))
    return kept.groupBy("direction").agg(F.count(F.lit(1)).alias("kept")).join(
        internal.groupBy("direction").agg(F.count(F.lit(1)).alias("internal")), "direction", "full"
    )


@query
def q_ip_hash(spark, sf):
    hashed = scrub.scrub_addresses(t.packet_table(spark, sf), salt=t.SALT)
    return hashed.groupBy("src_ip").agg(F.count(F.lit(1)).alias("packets"), F.sum("wire_len").alias("bytes"))


@query
def q_scrub_frames(spark, sf):
    frames = scrub.scrub_frames(t.frame_table(spark, sf), salt=t.SALT)
    return frames.select("event_id", F.hex("pkt").alias("frame"))


@query
def q_tag_hash(spark, sf):
    log = sampling.accepted_commands(t.trigger_log(spark, sf)).where(F.col("action") == "trigger")
    return log.select("tag").distinct().select("tag", hashing.tag_fingerprint(F.col("tag")).alias("tag_hash"))


@query
def q_sample_1_in_n(spark, sf):
    kept = sampling.one_in_n(t.packet_table(spark, sf), ["cpu"], ["ts_ns", "event_id"], "ts_ns", HOUR_NS, F.lit(7))
    return kept.select("event_id", "cpu")


def regimes_of(spark, sf):
    return sampling.regimes(t.trigger_log(spark, sf), slice_sec=5 * t.DAY)


@query
def q_regime(spark, sf):
    return regimes_of(spark, sf)


def packets_in_regime(spark, sf):
    timed = t.packet_table(spark, sf).select("event_id", "cpu", "ts_ns", "wire_len", div(F.col("ts_ns"), 1_000_000_000).alias("ts"))
    return sampling.in_regime(timed, regimes_of(spark, sf))


@query
def q_packets_in_regime(spark, sf):
    return packets_in_regime(spark, sf).select("event_id", "start_ts", "active", "rate", "incident_tag", "trigger_ts")


@query
def q_sample_in_regime(spark, sf):
    active = packets_in_regime(spark, sf).where("active")
    kept = sampling.one_in_n(active, ["cpu", "start_ts"], ["ts_ns", "event_id"], "ts_ns", HOUR_NS, F.col("rate"))
    return kept.select("event_id", "incident_tag", "trigger_ts")


@query
def q_sample_with_carry(spark, sf):
    kept = sampling.sample_with_carry(packets_in_regime(spark, sf), "cpu", ["ts_ns", "event_id"], "ts_ns", HOUR_NS, 3)
    return kept.select("event_id", "incident_tag", "trigger_ts")


# -- retention, quality, comparison -----------------------------------------


@query
def q_hour_partitions(spark, sf):
    seconds = t.packet_table(spark, sf).select(div(F.col("ts_ns"), 1_000_000_000).alias("ts"))
    hours = seconds.groupBy(timetext.hour_name(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("packets"))
    return hours.select("hour", timetext.hour_seconds(F.col("hour")).alias("hour_ts"), "packets")


@query
def q_retention(spark, sf):
    from abuse_lens.sinks import retention

    seconds = t.packet_table(spark, sf).select(div(F.col("ts_ns"), 1_000_000_000).alias("ts"))
    hours = seconds.select(timetext.hour_seconds(timetext.hour_name(F.col("ts"))).alias("hour_ts")).distinct()
    return retention.verdicts(hours, "hour_ts", 1_706_600_000, max_age_sec=20 * t.DAY, max_files=300)


@query
def q_run_dir_names(spark, sf):
    log = sampling.accepted_commands(t.trigger_log(spark, sf)).where(F.col("action") == "trigger")
    return log.select(
        "seq", timetext.run_dir_name(F.col("ts")).alias("run_dir"),
        F.concat_ws("-", "tag", F.col("ts").cast("string")).alias("incident_dir"),
    )


def marked_events(spark, sf):
    c = F.col
    return t.packet_table(spark, sf).select(
        "src_port", "dst_port", "wire_len", F.when(c("k") % 10 == 3, 2).when(c("direction") == "egress", 1).otherwise(0).alias("direction"),
        F.least(c("wire_len"), F.lit(900 + 3 * 100)).cast("int").alias("cap_len"), div(c("ts_ns"), DAY_NS).alias("window"),
    )


@query
def q_quality(spark, sf):
    return quality.event_quality(marked_events(spark, sf), ["window"], quality.packet_defect(), rpc.server_direction([8000]))


@query
def q_window_results(spark, sf):
    """What a collector reports of every minute: events, losses and pairs."""
    from abuse_lens.operators import framing

    minute = lambda ts: div(F.col(ts), 60_000_000_000)
    events = t.payload_events(spark, sf).withColumn("window", minute("ts_ns"))
    hidden = (F.col("src_ip") % 7 == 0) & (F.col("dst_port") == 8899)
    counted = quality.event_quality(events, ["window"], quality.payload_defect(), F.lit("known"), hidden)
    messages = framing.frame_messages(rpc.directed(events.drop("direction", "window"), [8899]), slice_ns=60_000_000_000)
    pairs = rpc.pair_messages(messages, ["flow_low", "flow_high"], ["done_ts", "done_seq"], "done_ts", 3_000_000_000)
    odd = events.where(F.pmod(F.col("tcp_seq"), F.lit(1400)) == 700)  # stands for a source's error log
    return quality.window_results(counted, pairs.withColumn("window", minute("resp_completed_ns")), ["window"], odd)


@query
def q_quality_totals(spark, sf):
    per_window = quality.event_quality(marked_events(spark, sf), ["window"], quality.packet_defect(), rpc.server_direction([8000]))
    return quality.run_totals(per_window)


@query
def q_quarantine(spark, sf):
    _, bad = quality.good_and_bad(marked_events(spark, sf), quality.packet_defect())
    return bad.groupBy("defect").agg(F.count(F.lit(1)).alias("events"))


@query
def q_result_diff(spark, sf):
    """Counters of both directions against ingress alone."""
    kept = packets.watched(t.packet_table(spark, sf), t.PORTS)
    return compare.multiset_diff(packets.both_counters(kept), packets.ingress_counters(kept))


@query
def q_fixed_text(spark, sf):
    e = t.read(spark, sf, "events")
    x = F.col("value")
    return e.select("event_id", *[numbers.fixed(x / 8, d).alias(f"d{d}") for d in (1, 2, 4)])


@query
def q_inferred_ports(spark, sf):
    from abuse_lens.sources import snapshots

    rows = packets.assemble_snapshots(t.cumulative_counters(spark, sf), (9999, 8000), t.DAY, 7, 1_704_067_200)
    return snapshots.ports_present(rows)


# -- framing ------------------------------------------------------------------


@query
def q_framing(spark, sf):
    """HTTP segments of the conversations back to messages."""
    from abuse_lens.operators import framing

    events = rpc.directed(t.payload_events(spark, sf).drop("direction"), [8899])
    messages = framing.frame_messages(events, slice_ns=1_000_001_000)
    return messages.select("flow_low", "direction", "body_len", "status", "first_ts", "done_ts", "rpc_parsed")


@query
def q_framing_rpc(spark, sf):
    """JSON-RPC responses among the messages, by error code."""
    from abuse_lens.operators import framing

    events = rpc.directed(t.payload_events(spark, sf, rpc=True).drop("direction"), [8899])
    messages = framing.frame_messages(events, slice_ns=60_000_000_000)
    return messages.groupBy("direction", "rpc_parsed", "rpc_error_code").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("body_len").alias("body_bytes")
    )


@query
def q_framed_pairs(spark, sf):
    from abuse_lens.operators import framing

    events = rpc.directed(t.payload_events(spark, sf).drop("direction"), [8899])
    messages = framing.frame_messages(events, slice_ns=60_000_000_000)
    pairs = rpc.pair_messages(messages, ["flow_low", "flow_high"], ["done_ts", "done_seq"], "done_ts", 3_000_000_000)
    return pairs.select("flow_low", "request_bytes", "response_bytes", "status_code", "req_started_ns", "resp_completed_ns")


@query
def q_head_fields(spark, sf):
    """Head fields of payloads that hold a whole head, without Python."""
    from abuse_lens.functions import http

    p = F.col("payload")
    starts = t.payload_events(spark, sf).where(F.col("tcp_seq") == 0)
    return starts.groupBy("direction", http.status_code(p).alias("status")).agg(
        F.sum(http.head_length(p)).cast("bigint").alias("head_bytes"), F.sum(http.content_length(p)).alias("body_bytes")
    )


@query
def q_rpc_envelopes(spark, sf):
    """JSON-RPC bodies of responses that one payload holds whole, without Python."""
    from abuse_lens.functions import http

    p = F.col("payload")
    first = t.payload_events(spark, sf, rpc=True).where((F.col("tcp_seq") == 0) & (F.col("direction") == 1))
    whole = first.where(http.head_length(p) + http.content_length(p) == F.octet_length(p))
    body = F.decode(F.substring(p, http.head_length(p) + 1, F.octet_length(p)), "UTF-8")
    read = whole.select(http.rpc_envelope(body).alias("e")).where("e.parsed")
    return read.groupBy(F.col("e.error_code").alias("error_code")).agg(F.count(F.lit(1)).alias("responses"))


@query
def q_payload_snapshots(spark, sf):
    """Window features as snapshot lines, parsed again."""
    from abuse_lens.plans.payload import payload_snapshots
    from abuse_lens.sources import snapshots

    windows = windowed_pairs(spark, sf).withColumn("w", F.col("window") * 60)
    ports = windows.select("w", F.col("client_port").alias("src_port"), F.lit(8899).alias("dst_port"))
    rows = payload_snapshots(rpc.response_aggregates(windows, ports, ["w"]), "w", 60, [8899], 1, 0)
    back = snapshots.parse(packets.snapshot_json(rows).select("value")).good
    kept = ["count", "resp_bytes_total", "req_bytes_max", "amp_ratio_median", "amp_ratio_max", "unique_src_ports", "duration_ns_mean",
            "status_4xx_frac", "rpc_error_distinct_codes"]
    return back.select("ts_unix_sec", "version", *[F.col("resp_aggregates")[k].alias(k) for k in kept])


# -- documents and sinks --------------------------------------------------------


def snapshot_rows_of(spark, sf):
    return packets.assemble_snapshots(t.cumulative_counters(spark, sf), t.PORTS, t.DAY, 7, 1_704_067_200)


@query
def q_report_evidence(spark, sf):
    """The whole report over JSON lines: parse, totals, verdicts, evidence document."""
    from abuse_lens.plans import documents, report
    from abuse_lens.sources import snapshots

    lines = packets.snapshot_json(snapshot_rows_of(spark, sf)).select("value")
    run = report.build(snapshots.parse(lines).good, t.CFG, allow(spark), NOW)
    return documents.evidence_lines(run).select("value")


def report_of(spark, sf):
    """The whole report over JSON lines."""
    from abuse_lens.plans import report
    from abuse_lens.sources import snapshots

    lines = packets.snapshot_json(snapshot_rows_of(spark, sf)).select("value")
    return report.build(snapshots.parse(lines).good, t.CFG, allow(spark), NOW)


@query
def q_rules_document(spark, sf):
    """rules.json, line by line."""
    from abuse_lens.plans import documents

    return documents.numbered(documents.rules_lines(report_of(spark, sf)))


@query
def q_report_document(spark, sf):
    """report.md, line by line."""
    from abuse_lens.plans import documents

    return documents.numbered(documents.report_lines(report_of(spark, sf)))


@query
def q_summary_document(spark, sf):
    """summary.json, line by line."""
    from abuse_lens.plans import documents

    return documents.numbered(documents.summary_lines(report_of(spark, sf)))


@query
def q_first_difference(spark, sf):
    """The first line on which the evidence changes when a key's first row counts in full."""
    from abuse_lens.plans import documents

    def evidence(cfg):
        return documents.numbered(documents.evidence_of(decisions_of(spark, sf, cfg)))

    return compare.first_difference(evidence(t.CFG), evidence(t.CFG.with_(first_appearance="raw")))


@query
def q_hourly_files(spark, sf):
    """Snapshots appended to hourly folders and read back."""
    import uuid

    from abuse_lens.plans.settle import shared_folder
    from abuse_lens.sinks import snapshots as sink
    from abuse_lens.sources import snapshots

    folder = f"{shared_folder(spark)}/hours-{uuid.uuid4().hex}"
    sink.append(snapshot_rows_of(spark, sf), folder)
    rows = snapshots.counter_rows(snapshots.parse(sink.read_hourly(spark, folder, "2024010500", "2024012023")).good)
    whole = snapshots.counter_rows(snapshots.parse(snapshots.read_lines(spark, folder)).good)
    counted = [F.count(F.lit(1)).alias("keys"), F.sum("bytes").alias("bytes")]
    some, every = rows.groupBy("ts").agg(*counted), whole.groupBy("ts").agg(*counted)
    return some.withColumn("hours", F.lit("range")).union(every.withColumn("hours", F.lit("all")))


def written_snapshots(spark, sf, parts=3):
    """A folder of hourly files as the sink leaves it, written in two goes."""
    import uuid

    from abuse_lens.plans.settle import shared_folder
    from abuse_lens.sinks import snapshots as sink

    folder = f"{shared_folder(spark)}/hours-{uuid.uuid4().hex}"
    rows = packets.assemble_snapshots(t.cumulative_counters(spark, sf), t.PORTS, t.DAY, 7, 1_704_067_200, parts=parts)
    odd = F.pmod(div(F.col("ts_unix_sec"), t.DAY), F.lit(2)) == 1
    sink.append(rows.where(odd), folder)
    sink.append(rows.where(~odd), folder)
    return folder


@query
def q_report_from_sink(spark, sf):
    """The report over the folder that the snapshot sink has written."""
    from abuse_lens.plans import documents, report

    run = report.from_directory(spark, written_snapshots(spark, sf), t.CFG, allow(spark), NOW)
    return documents.evidence_lines(run).select("value")


@query
def q_snapshot_files(spark, sf):
    """Hours of the files in the sink's folder, oldest first, by place."""
    from abuse_lens.sources import snapshots

    found = snapshots.snapshot_files(snapshots.read_lines(spark, written_snapshots(spark, sf)))
    return found.groupBy("hour_ts").agg(F.lit(1).cast("bigint").alias("seen"))


def written_incidents(spark, sf, max_bytes):
    """A folder of packets recorded per CPU and day."""
    import uuid

    from abuse_lens.plans.settle import shared_folder
    from abuse_lens.sinks import incidents

    day = div(F.col("ts_ns"), DAY_NS) * t.DAY
    recorded = packets.snapped(t.frame_table(spark, sf)).select(
        "event_id", "pkt", F.concat(F.lit("cpu-"), F.col("cpu")).alias("incident_tag"), day.alias("trigger_ts")
    )
    folder = f"{shared_folder(spark)}/incidents-{uuid.uuid4().hex}"
    incidents.write(recorded, folder, max_bytes=max_bytes)
    return folder


RECORDED = "event_id bigint, pkt binary, incident_tag string, trigger_ts bigint"


@query
def q_incident_files(spark, sf):
    """Packets written in segments and read back; none of a segment's files has more records than fit."""
    back = spark.read.schema(RECORDED).parquet(written_incidents(spark, sf, 5400))
    per_file = back.groupBy("incident_tag", "trigger_ts", F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.length("pkt")).alias("captured")
    )
    return per_file.groupBy("incident_tag", "trigger_ts").agg(
        F.sum("packets").alias("packets"), F.sum("captured").alias("captured"),
        (F.max("packets") <= 5400 // (38 + 16)).alias("within"),
    )


@query
def q_incident_segments(spark, sf):
    """Packets of many sizes, cut into segments by their bytes, written and read back."""
    import uuid

    from abuse_lens.plans.settle import shared_folder
    from abuse_lens.sinks import incidents

    more = F.pmod(F.col("event_id") * 7919 + F.col("wire_len"), F.lit(900)).cast("int")
    recorded = packets.snapped(t.frame_table(spark, sf)).select(
        "event_id", "ts_ns", F.concat("pkt", F.unhex(F.repeat(F.lit("00"), more))).alias("pkt"),
        F.concat(F.lit("cpu-"), F.col("cpu")).alias("incident_tag"), (div(F.col("ts_ns"), 30 * DAY_NS) * 30 * t.DAY).alias("trigger_ts"),
    )
    folder = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    incidents.write_segments(recorded, folder, ["ts_ns", "event_id"], "ts_ns", HOUR_NS, max_bytes=20_000)
    counted = lambda back: back.groupBy("incident_tag", "trigger_ts", "segment").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.length("pkt") + incidents.RECORD_HEADER).alias("bytes"),
        F.min("event_id").alias("least_id"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
    )
    return incidents.per_trigger(spark, folder, f"ts_ns bigint, {RECORDED}, segment bigint", counted)


@query
def q_archive(spark, sf):
    """All triggers archived; what the copies hold."""
    from abuse_lens.sinks import incidents

    folder = written_incidents(spark, sf, 1_000_000)
    incidents.archive(spark, folder, f"{folder}-archive", 4_000_000_000, 3600)
    copies = spark.read.schema(f"{RECORDED}, source_file string").parquet(f"{folder}-archive")
    return copies.groupBy("incident_tag", "trigger_ts").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.length("pkt")).alias("captured")
    )


# -- streams --------------------------------------------------------------------


def far_row(table, **values):
    """One row of the table's schema, null but for ``values``."""
    return table.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema])


def late(name):
    """A fifth of the rows arrive one turn late."""
    return (F.pmod(F.xxhash64(name), F.lit(5)) == 0).cast("bigint")


def reading_files(spark, sf):
    """Readings that arrive week by week and out of order, and what closes the stream."""
    readings = t.meter_readings(spark, sf)
    zeros = {c: 0 for c in ("syn", "ack", "handshake_ack", "rst", "packets", "bytes", "key_ord", "base_ts", "ip_u32", "dst_port")}
    closing = far_row(readings, ts=4_000_000_000, seq="", key_type="src_ip", **zeros)
    return readings, div(F.col("ts"), 7 * t.DAY) + late("seq"), closing


@query
def q_stream_deltas(spark, sf):
    from abuse_lens.streaming import episodes as stream
    from abuse_lens.streaming import windows

    readings, turn, closing = reading_files(spark, sf)
    forget = 1000 * t.DAY  # the twin forgets no key
    rows = windows.replay(readings, turn, lambda s: stream.stream_deltas(s, "8 days", forget), closing)
    return rows.where("ip_u32 <> 0").groupBy("ip_u32", "first").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(f"d_{c}").alias(c) for c in ("syn", "ack", "rst", "packets", "bytes")]
    )


METER_CFG = t.CFG.with_(syn_rate_threshold=900.0, success_ratio_threshold=0.02, vol_syn_rate=1200.0, vol_pkt_rate=100.0, vol_byte_rate=9000.0)


@query
def q_stream_episodes(spark, sf):
    """Episodes of the reading stream, those still open at its end as well."""
    from abuse_lens.streaming import episodes as stream
    from abuse_lens.streaming import windows

    readings, turn, closing = reading_files(spark, sf)
    build = lambda s: stream.stream_episodes(s, METER_CFG, 60, "8 days", idle_intervals=1000 * t.DAY // 60)
    return windows.replay(readings, turn, build, closing).where("ip_u32 <> 0").select(*EPISODE)


@query
def q_stream_pairs(spark, sf):
    from abuse_lens.streaming import flows, windows

    events = t.payload_events(spark, sf)
    zeros = {c: 0 for c in ("src_ip", "dst_ip", "src_port", "direction", "payload_len", "sample_len", "tcp_seq")}
    closing = far_row(events, ts_ns=4 * 10**18, dst_port=8899, payload=b"", **zeros)
    turn = div(F.col("ts_ns") - t.START_NS, 4_000_000_000) + late("ts_ns")
    pairs = windows.replay(events, turn, lambda s: flows.stream_pairs(s, [8899], "1 hour", 3600), closing)
    return pairs.select("flow_low", "request_bytes", "response_bytes", "status_code", "req_started_ns", "resp_completed_ns")


def packet_files(spark, sf):
    """Packets that arrive week by week, some a week late, the time of the last one, and what closes the stream."""
    seen = t.packet_table(spark, sf)
    last = seen.agg(F.max("ts_ns").alias("ts")).first().ts or 0
    row = {"ts_ns": last + 9 * DAY_NS, "direction": "ingress", "ip_version": 4, "proto": 6, "src_ip": 0, "dst_ip": 0, "src_port": 1, "dst_port": 8000, "wire_len": 0}
    flags = {f.name: False for f in seen.schema if f.dataType.simpleString() == "boolean"}
    return seen, div(F.col("ts_ns"), 7 * DAY_NS) + late("event_id"), last, far_row(seen, **row, **flags)


@query
def q_stream_counter_windows(spark, sf):
    """Hourly counters of the packet stream, the last hour included."""
    from abuse_lens.streaming import windows

    seen, turn, last, closing = packet_files(spark, sf)
    rows = windows.replay(seen, turn, lambda s: windows.counter_windows(s, t.PORTS, 3600, "8 days"), closing)
    return rows.where(F.col("ts") <= last // 1_000_000_000)


@query
def q_stream_incident_files(spark, sf):
    """Recorded packets by trigger out of a stream whose first batch is written twice; each packet counts once."""
    import uuid

    from pyspark.errors import StreamingQueryException

    from abuse_lens.plans.settle import shared_folder
    from abuse_lens.sinks import batches, incidents

    day = div(F.col("ts_ns"), DAY_NS) * t.DAY
    recorded = packets.snapped(t.frame_table(spark, sf)).select(
        "event_id", "pkt", F.concat(F.lit("cpu-"), F.col("cpu")).alias("incident_tag"), day.alias("trigger_ts")
    )
    base = f"{shared_folder(spark)}/incident-stream-{uuid.uuid4().hex}"
    recorded.repartition(8, "event_id").write.parquet(f"{base}/in")
    source = spark.readStream.schema(RECORDED).option("maxFilesPerTrigger", 3).parquet(f"{base}/in")

    class Lost(batches.BatchTable):
        """Its driver is lost when rows of a batch are written and not yet committed."""

        def commit(self, spark, batch, attempt):
            raise RuntimeError("driver lost")

    table = batches.BatchTable(f"{base}/out", incidents.KEYS)
    try:
        Lost(table.root, table.keys).start(source, f"{base}/progress", availableNow=True).awaitTermination()
    except StreamingQueryException:
        pass
    table.start(source, f"{base}/progress", availableNow=True).awaitTermination()
    table.write(recorded, 0)  # a batch that comes again after its manifest
    return table.read(spark, RECORDED).groupBy("incident_tag", "trigger_ts").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.length("pkt")).alias("captured")
    )


@query
def q_stream_idle_windows(spark, sf):
    """Packet windows of a minute, with a row for empty minutes, out of the stream."""
    from abuse_lens.streaming import features, windows

    def build(stream):
        timed = windows.event_time(stream, "ts_ns", "8 days")
        counted = timed.groupBy(F.window("event_time", "60 seconds").alias("span")).agg(F.count(F.lit(1)).alias("packets"), F.sum("wire_len").alias("bytes"))
        return features.with_empty_windows(counted, "span", 60)

    seen, turn, last, closing = packet_files(spark, sf)
    rows = windows.replay(seen, turn, build, closing)
    rows = rows.select(div(F.col("window_start"), 60).alias("minute"), "packets", "bytes")
    return rows.where(F.col("minute") <= last // 60_000_000_000)


@query
def q_stream_window_features(spark, sf):
    """All features of ten-second windows of the pair stream, the last one included."""
    from abuse_lens.streaming import features, windows

    pairs = pairs_of(spark, sf)
    last = pairs.agg(F.max("resp_completed_ns").alias("ts")).first().ts or 0
    closing = far_row(pairs, resp_completed_ns=last + 100 * 1_000_000_000)
    turn = F.pmod(div(F.col("resp_completed_ns"), 10_000_000_000), F.lit(4))

    def build(stream):
        ports = stream.select(F.col("resp_completed_ns").alias("ts_ns"), F.lit(8545).alias("dst_port"), (F.col("flow") % 1000).alias("src_port"))
        return features.window_features(stream, ports, 10, "1000 days")

    rows = windows.replay(pairs, turn, build, closing.withColumn("resp_completed_ns", F.lit(last + 1001 * DAY_NS)))
    rows = rows.where(F.col("window_start") <= last // 1_000_000_000)
    return rows.withColumn("amp_ratio_mean", F.round("amp_ratio_mean", 9))


@query
def q_stream_quality(spark, sf):
    """Events, rejected and unwatched ones, counted while the stream runs and summed from its table of batches."""
    import uuid

    from abuse_lens.plans.settle import shared_folder
    from abuse_lens.streaming import metrics, windows

    events = marked_events(spark, sf)
    counters = metrics.BatchCounters(spark, f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}")
    spark.streams.addListener(counters)
    build = lambda s: metrics.observed(s, quality.packet_defect(), rpc.server_direction([8000]))
    windows.replay(events, F.pmod(F.col("window"), F.lit(3)), build, events.limit(0), 2, counters.wait)
    spark.streams.removeListener(counters)
    return counters.read().agg(*[F.sum(c).alias(f"total_{c}") for c in metrics.COUNTERS])
