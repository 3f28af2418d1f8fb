import random

import pytest
from abuse_lens.config import ReportConfig
from abuse_lens.operators import deltas, episodes
from abuse_lens.operators.slices import lag_in_slices, running_in_slices, with_slice
from helpers import counter, counters
from pyspark.sql import Window
from pyspark.sql import functions as F

CFG = ReportConfig(window_sec=10)
RAW = CFG.with_(first_appearance="raw")


def syn_totals(spark, rows, cfg, width=60):
    d = deltas.with_deltas(counters(spark, rows), width)
    return {r.ip_u32: r.total_syn for r in deltas.run_totals(d, cfg).collect()}


@pytest.mark.parametrize(
    "rows, raw, baseline",
    [
        ([(0, 100), (60, 200)], 200, 100),
        ([(0, 100), (60, 30)], 100, 0),
        ([(0, 100), (120, 20)], 100, 0),
        ([(60, 50), (120, 100)], 100, 50),
        ([(0, 100)], 100, None),
        ([(0, 10), (60, 20), (120, 5), (180, 25)], 40, 30),
    ],
)
def test_first_appearance_and_resets(spark, rows, raw, baseline):
    data = [counter(ts, syn) for ts, syn in rows]
    assert syn_totals(spark, data, RAW) == {167772161: raw}
    assert syn_totals(spark, data, CFG) == ({} if baseline is None else {167772161: baseline})


def test_totals_of_counters_equal_totals_of_deltas(spark):
    rng = random.Random(3)
    rows = []
    for ip in range(1, 12):
        for i in sorted(rng.sample(range(60), rng.randrange(1, 40))):
            rows.append(counter(60 * i, rng.randrange(1000), ip=ip, port=rng.choice([80, None]), hs=rng.randrange(100), base_ts=0))
    table = counters(spark, rows)
    for cfg in (CFG, RAW):
        want = sorted(map(repr, deltas.run_totals(deltas.with_deltas(table, 10**6), cfg).collect()))
        for width in (60, 300, 10**6):
            assert sorted(map(repr, deltas.totals_of_counters(table, cfg, width).collect())) == want


def test_keys_are_separate_and_ports_may_be_missing(spark):
    data = [counter(0, 1, port=None), counter(60, 4, port=None), counter(0, 10, port=80), counter(60, 30, port=80),
            counter(0, 5, port=80, ord_=1), counter(60, 6, port=80, ord_=1)]
    got = deltas.run_totals(deltas.with_deltas(counters(spark, data), 60), CFG).collect()
    assert sorted((r.key_type, r.dst_port or 0, r.total_syn) for r in got) == [
        ("src_cidr24", 80, 1), ("src_ip", 0, 3), ("src_ip", 80, 20)
    ]


def test_rates_divide_by_window_not_run_length(spark):
    data = [counter(60 * i, 100 * i, hs=50 * i, packets=200 * i, size=1000 * i) for i in range(11)]
    r = deltas.run_totals(deltas.with_deltas(counters(spark, data), 120), CFG).first()
    assert (r.syn_rate, r.pkt_rate, r.byte_rate, r.success_ratio) == (100.0, 200.0, 1000.0, 0.5)
    zero = deltas.run_totals(deltas.with_deltas(counters(spark, data), 120), CFG.with_(window_sec=0)).first()
    assert (zero.syn_rate, zero.pkt_rate) == (0.0, 0.0)


def test_first_interval_counts_only_at_run_start(spark):
    data = [counter(1000, 50, base_ts=1000), counter(1060, 110, base_ts=1000), counter(1060, 7, ip=9, base_ts=1000),
            counter(1120, 9, ip=9, base_ts=1000)]
    iv = deltas.interval_stats(deltas.with_deltas(counters(spark, data), 60), CFG, 60)
    got = sorted((r.ip_u32, r.ts, r.syn, r.syn_rate) for r in iv.collect())
    assert got == [(9, 1120, 2, 2 / 60), (167772161, 1000, 50, 5.0), (167772161, 1060, 60, 1.0)]


def test_runs_share_one_chain_unless_separated(spark):
    rows = counters(spark, [counter(0, 100), counter(60, 150), counter(61, 10), counter(121, 30)])
    rows = rows.withColumn("run_id", F.when(F.col("syn").isin(100, 150), 1).otherwise(2).cast("bigint"))
    together = deltas.run_totals(deltas.with_deltas(rows, 600), CFG).first().total_syn
    apart = deltas.run_totals(deltas.with_deltas(rows, 600, by_run=True), CFG).first().total_syn
    assert (together, apart) == (70, 70)
    merged = counters(spark, [counter(0, 100), counter(30, 10), counter(60, 150), counter(90, 30)])
    merged = merged.withColumn("run_id", F.when(F.col("ts").isin(0, 60), 1).otherwise(2).cast("bigint"))
    together = deltas.run_totals(deltas.with_deltas(merged, 600), CFG).first().total_syn
    apart = deltas.run_totals(deltas.with_deltas(merged, 600, by_run=True), CFG).first().total_syn
    assert (together, apart) == (140, 70)


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_sliced_windows_equal_plain_windows(spark, width):
    rng = random.Random(width)
    # One key holds most rows and gaps are longer than slices.
    rows, ts = [], 0
    for i in range(400):
        ts += rng.choice([1, 1, 2, 90])
        rows.append((0 if rng.random() < 0.7 else rng.randrange(1, 5), ts, i, rng.randrange(-50, 50), rng.choice([None, ts])))
    df = spark.createDataFrame(rows, "k int, ts bigint, seq int, v bigint, mark bigint")
    w = Window.partitionBy("k").orderBy("ts", "seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select(
        "k", "ts", "seq", F.lag("v").over(w).alias("p"), F.sum("v").over(run).alias("s"), F.max("mark").over(run).alias("m")
    )
    sliced, at = with_slice(df, "ts", width)
    lagged = lag_in_slices(sliced, ["k"], ["ts", "seq"], at, ["v"]).select("k", "ts", "seq", F.col("prev.v").alias("p"))
    running = running_in_slices(
        sliced, ["k"], ["ts", "seq"], at, {"s": ("sum", F.col("v")), "m": ("max", F.col("mark"))}
    ).select("k", "ts", "seq", "s", "m")
    both = lagged.join(running, ["k", "ts", "seq"]).select("k", "ts", "seq", "p", "s", "m")
    assert sorted(both.collect(), key=lambda r: r.seq) == sorted(plain.collect(), key=lambda r: r.seq)


def test_delta_totals_are_last_minus_first_for_growing_counters(spark):
    rng = random.Random(5)
    rows, spans = [], {}
    for ip in range(1, 30):
        value, first = rng.randrange(100), None
        for i in range(rng.randrange(1, 40)):
            value += rng.randrange(20)
            first = value if first is None else first
            rows.append(counter(60 * i, value, ip=ip))
        spans[ip] = value - first
    got = syn_totals(spark, rows, CFG, width=300)
    assert all(spans[ip] == total for ip, total in got.items())


INTERVAL = (
    "key_ord int, ip_u32 bigint, port_key int, run_key bigint, ts bigint, seq string, syn bigint, packets bigint, "
    "bytes bigint, syn_rate double, pkt_rate double, byte_rate double, success_ratio double"
)


def intervals(spark, rows):
    full = [(0, ip, 80, 0, ts, "", int(s * 60), int(p * 60), int(b * 60), float(s), float(p), float(b), float(r)) for ip, ts, s, p, b, r in rows]
    return spark.createDataFrame(full, INTERVAL)


def found(spark, rows, cfg=CFG.with_(slice_intervals=2)):
    ep = episodes.detect_episodes(intervals(spark, rows), cfg, 60)
    return [r.asDict() for r in ep.orderBy("start_ts", "src_ip").collect()]


def test_consecutive_hot_intervals_merge_and_cold_ones_split(spark):
    hot, cold = (150, 150, 0, 0.05), (1, 1, 0, 0.9)
    rows = [(1, 60 * i, *(cold if i in (4, 9) else hot)) for i in range(12)]
    got = [(e["start_ts"], e["end_ts"], e["interval_count"], e["episode_type"]) for e in found(spark, rows)]
    assert got == [(0, 180, 4, "multi_window"), (300, 480, 4, "multi_window"), (600, 660, 2, "multi_window")]


def test_one_long_run_over_many_slices(spark):
    rows = [(1, 60 * i, 150, 150, 0, 0.05) for i in range(300)]
    (e,) = found(spark, rows)
    assert (e["interval_count"], e["duration_sec"], e["total_syn"]) == (300, 18000, 300 * 9000)


def test_gap_in_snapshots_does_not_split(spark):
    rows = [(1, 0, 150, 150, 0, 0.0), (1, 6000, 150, 150, 0, 0.0)]
    (e,) = found(spark, rows)
    assert (e["interval_count"], e["duration_sec"], e["episode_type"]) == (2, 6060, "multi_window")


def test_single_window_and_minimum_length(spark):
    rows = [(1, 0, 150, 150, 0, 0.0), (1, 60, 0, 0, 0, 0.0)]
    assert found(spark, rows)[0]["episode_type"] == "single_window"
    assert found(spark, rows, CFG.with_(min_episode_intervals=2)) == []


def test_peaks_minimum_ratio_and_class_mix_intervals(spark):
    # Flood in one interval, volume in the other: extremes decide, flood first.
    rows = [(1, 0, 600, 1200, 5e6, 0.08), (1, 60, 700, 100, 2e6, 0.9)]
    (e,) = found(spark, rows)
    assert (e["max_syn_rate"], e["max_pkt_rate"], e["max_byte_rate"], e["min_success_ratio"]) == (700, 1200, 5e6, 0.08)
    assert e["abuse_class"] == "SYN_FLOOD_LIKE"


def test_no_syn_gives_zero_ratio_and_volume_class(spark):
    (e,) = found(spark, [(1, 0, 0, 1000, 1e6, 0.0)])
    assert (e["min_success_ratio"], e["abuse_class"]) == (0.0, "VOLUMETRIC_TCP_ABUSE")


@pytest.mark.parametrize(
    "rates, hot",
    [((100, 0, 0, 0.1), True), ((99.9, 0, 0, 0.0), False), ((100, 0, 0, 0.1001), False), ((500, 1000, 0, 1.0), True),
     ((0, 1000, 1e6, 1.0), True), ((500, 999, 999999, 1.0), False)],
)
def test_exact_thresholds(spark, rates, hot):
    assert bool(found(spark, [(1, 0, *rates)])) is hot


def test_trigger_reason_text(spark):
    ep = episodes.detect_episodes(intervals(spark, [(1, 0, 150, 1, 1, 0.05), (2, 0, 500, 2000.25, 0, 0.7)]), CFG, 60)
    got = {r.ip_u32: r.t for r in ep.select("ip_u32", episodes.trigger_reason(CFG).alias("t")).collect()}
    assert got == {
        1: "syn_rate 150.0 >= 100.0 AND success_ratio 0.0500 <= 0.1000",
        2: "2 of 3 volumetric: syn_rate 500.0 >= 500.0, pkt_rate 2000.2 >= 1000.0",
    }
