import random

import pytest

from abuse_lens.config import ReportConfig
from abuse_lens.operators import deltas, episodes, packets, rpc
from abuse_lens.operators import framing
from abuse_lens.sources import snapshots
from abuse_lens.sinks import snapshots as sink
from abuse_lens.streaming import episodes as stream_ep
from abuse_lens.streaming import flows, windows
from helpers import COUNTER_SCHEMA, counter, counters
from pyspark.sql import functions as F
from test_framing import EVENTS, events_of, http
from test_traffic import PACKETS, packet

CFG = ReportConfig(window_sec=10, syn_rate_threshold=1.0)


def stream(spark, tmp_path, batches, schema, name="in"):
    """A parquet file stream that delivers one batch per trigger."""
    source = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    reader = spark.readStream.schema(spark.read.parquet(str(source)).schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(source))


def run(df, tmp_path, name, mode="append"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.table(name)


def counter_batches():
    rng = random.Random(2)
    total, batches = {ip: 0 for ip in range(1, 6)}, []
    for i in range(24):
        rows = []
        for ip in total:
            if rng.random() < 0.15:
                continue
            total[ip] += rng.choice([0, 30, 90, 200])
            rows.append(counter(1000 + 60 * i, total[ip], ip=ip, base_ts=1000, hs=total[ip] // 50))
        batches.append(rows)
    return [sum(batches[i : i + 6], []) for i in range(0, 24, 6)]


def test_streamed_deltas_equal_batch(spark, tmp_path):
    batches = counter_batches()
    rows = sum(batches, [])
    random.Random(4).shuffle(rows)  # arrival has nothing to do with time
    mixed = [rows[i::4] for i in range(4)] + [[counter(10**7, 1, ip=77)]]
    source = stream(spark, tmp_path, mixed, COUNTER_SCHEMA)
    out = run(stream_ep.stream_deltas(source, "1 hour"), tmp_path, "s_deltas").where("ip_u32 <> 77")
    columns = ["ip_u32", "ts", "first", "d_syn", "d_packets", "d_bytes"]
    batch = deltas.with_deltas(counters(spark, sum(batches, [])), 600)
    got, want = (sorted(map(tuple, d.select(*columns).collect()), key=repr) for d in (out, batch))
    assert got == want


def test_streamed_episodes_equal_batch(spark, tmp_path):
    batches = counter_batches()
    rows = sum(batches, [])
    random.Random(5).shuffle(rows)
    mixed = [rows[i::5] for i in range(5)] + [[counter(10**7, 1, ip=77)]]  # a far row closes what is open
    source = stream(spark, tmp_path, mixed, COUNTER_SCHEMA)
    out = run(stream_ep.stream_episodes(source, CFG, 60, "1 hour", 1000), tmp_path, "s_eps")
    iv = deltas.interval_stats(deltas.with_deltas(counters(spark, sum(batches, [])), 600), CFG, 60)
    batch = episodes.detect_episodes(iv, CFG, 60)
    columns = ["src_ip", "dst_port", "start_ts", "end_ts", "duration_sec", "interval_count", "episode_type", "max_syn_rate",
               "max_pkt_rate", "max_byte_rate", "min_success_ratio", "total_syn", "total_bytes", "abuse_class"]
    got, want = (sorted(map(tuple, d.select(*columns).collect()), key=repr) for d in (out, batch))
    assert want and got == want


def test_late_rows_are_ordered_or_dropped(spark, tmp_path):
    readings = [[1000, 3000], [2000, 4000], [500, 5000]]
    batches = [[counter(ts, ts, ip=1) for ts in b] for b in readings] + [[counter(10**7, 1, ip=77)]]
    for lateness, total in (("10000 seconds", 4500), ("1000 seconds", 4000)):  # the second is too short for the row of 500
        source = stream(spark, tmp_path, batches, COUNTER_SCHEMA, f"late{total}")
        out = run(stream_ep.stream_deltas(source, lateness), tmp_path, f"s_late{total}").where("ip_u32 = 1 and not first")
        assert sum(r.d_syn for r in out.collect()) == total


def test_a_row_late_within_the_lateness_stays_in_its_run(spark, tmp_path):
    batches = [[counter(1000, 0, ip=1), counter(1060, 300, ip=1), counter(1180, 900, ip=1)], [counter(1120, 600, ip=1)], [counter(10**7, 1, ip=77)]]
    source = stream(spark, tmp_path, batches, COUNTER_SCHEMA)
    out = run(stream_ep.stream_episodes(source, CFG, 60, "1000 seconds"), tmp_path, "s_late_run")
    assert [(r.start_ts, r.end_ts, r.interval_count) for r in out.collect()] == [(1060, 1180, 3)]


def test_silent_key_is_closed_by_timeout(spark, tmp_path):
    hot = [[counter(1000 + 60 * i, 300 * i, ip=1) for i in range(3)], [counter(9000, 1, ip=2)], [counter(9060, 1, ip=2)]]
    out = run(stream_ep.stream_episodes(stream(spark, tmp_path, hot, COUNTER_SCHEMA), CFG, 60), tmp_path, "s_idle")
    assert [(r.src_ip, r.start_ts, r.end_ts, r.interval_count) for r in out.collect()] == [("0.0.0.1", 1060, 1120, 2)]


def test_streamed_pairs_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for conn in range(3):
        script = []
        for i in range(15):
            script += [(False, http(False, b"q" * rng.randrange(2000))), (True, http(True, b"r" * rng.randrange(6000)))]
        rows += events_of(rng, conn, script)
    # Well after 1970: the first watermark stands at 0 and drops what is not later.
    rows = sorted(((*r[:5], r[5] + 10**15, *r[6:]) for r in rows), key=lambda r: (r[5], r[4]))
    step = len(rows) // 4 + 1
    batches = [rows[i : i + step] for i in range(0, len(rows), step)]
    batches = [a[:-3] + b for a, b in zip(batches, [[], *[a[-3:] for a in batches]])] + [batches[-1][-3:]]
    batches.append([(77, *rows[0][1:5], 10**18, *rows[0][6:])])
    source = stream(spark, tmp_path, batches, EVENTS).withColumn("direction", F.lit(0))
    out = run(flows.stream_pairs(source, [80]), tmp_path, "s_pairs")
    messages = framing.frame_messages(rpc.directed(spark.createDataFrame(rows, EVENTS), [80]), 500)
    batch = rpc.pair_messages(messages, framing.FLOW, ["done_ts", "done_seq"], "done_ts", 500)
    columns = ["flow_low", "request_bytes", "response_bytes", "status_code", "req_started_ns", "resp_completed_ns"]
    got, want = (sorted(map(tuple, d.select(*columns).collect())) for d in (out, batch))
    assert len(want) == 45 and got == want


def test_streamed_counter_windows_equal_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [packet(ts=t * 10**9, src=rng.randrange(3), syn=rng.random() < 0.5, ack=True, wire=rng.randrange(1500)) for t in range(0, 600, 3)]
    batches = [rows[i : i + 50] for i in range(0, len(rows), 50)] + [[packet(ts=5000 * 10**9)]]
    out = run(windows.counter_windows(stream(spark, tmp_path, batches, PACKETS), [80]), tmp_path, "s_counters")
    batch = packets.interval_counters(spark.createDataFrame(rows, PACKETS), 60)
    columns = ["ts", "ip_u32", "dst_port", "syn", "ack", "packets", "bytes"]
    got, want = (sorted(map(tuple, d.select(*columns).collect())) for d in (out, batch))
    assert got == want


def test_streamed_pair_windows(spark, tmp_path):
    from test_traffic import PAIRS

    rows = [(1, 10, 10 * i, 200 if i % 2 else 404, i * 10**9, i * 10**9 + 5, False, None) for i in range(1, 130)]
    batches = [rows[:60], rows[60:], [(1, 1, 1, 200, 0, 9000 * 10**9, False, None)]]
    out = run(windows.pair_windows(stream(spark, tmp_path, batches, PAIRS)), tmp_path, "s_win")
    got = {r.window_start: (r["count"], r.resp_bytes_total, r.status_2xx, r.status_4xx, r.duration_ns_max) for r in out.collect()}
    assert got == {0: (59, sum(range(10, 600, 10)), 30, 29, 5), 60: (60, sum(range(600, 1200, 10)), 30, 30, 5),
                   120: (10, sum(range(1200, 1300, 10)), 5, 5, 5)}


def test_streamed_snapshots_are_readable(spark, tmp_path):
    data = [counter(1704160800 + 1800 * i, i + 1) for i in range(4)]
    snaps = packets.assemble_snapshots(counters(spark, data), (8080,), 1800, 1, 0)
    path = str(tmp_path / "snaps")
    snaps.write.parquet(path)
    source = spark.readStream.schema(snaps.schema).parquet(path)
    out = str(tmp_path / "out")
    sink.hourly(source)
    windows.write_snapshots(source, out, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    back = snapshots.counter_rows(snapshots.parse_strict(sink.read_hourly(spark, out)))
    assert sorted((r.ts, r.syn) for r in back.collect()) == [(d[0], d[7]) for d in data]


def test_streamed_features_equal_batch(spark, tmp_path):
    from abuse_lens.streaming import features
    from test_traffic import PAIRS

    rng = random.Random(9)
    sec = 10**9
    rows = []
    for i in range(150):
        asked = 10**6 * sec + rng.randrange(300) * sec
        code = rng.choice([None, *range(8)])
        rows.append((i % 4, rng.choice([0, 3, 10, 40]), rng.randrange(500), rng.choice([None, 200, 404, 503]), asked, asked + rng.choice([-5, 5, 7 * sec]), rng.random() < 0.6, code))
    batches = [rows[i::3] for i in range(3)] + [[(1, 1, 1, 200, 0, 2 * 10**6 * sec, False, None)]]
    pairs = stream(spark, tmp_path, batches, PAIRS)
    ports = lambda p: p.select(F.col("resp_completed_ns").alias("ts_ns"), F.lit(80).alias("dst_port"), (F.col("resp_completed_ns") % 7).cast("int").alias("src_port"))
    out = run(features.window_features(pairs, ports(pairs), 60, "1 hour"), tmp_path, "s_features").where("window_start < 1500000")
    window = (F.floor(F.col("resp_completed_ns") / (60 * sec)) * 60).alias("window_start")
    table = spark.createDataFrame(rows, PAIRS)
    events = ports(table).select("*", (F.floor(F.col("ts_ns") / (60 * sec)) * 60).alias("window_start"))
    batch = rpc.response_aggregates(table.select("*", window), events, ["window_start"])
    names = sorted(out.columns)
    assert names == sorted(batch.columns)
    rounded = lambda rows: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert out.count() >= 5 and rounded(out.select(*names).collect()) == rounded(batch.select(*names).collect())


def test_empty_windows_are_given_out(spark, tmp_path):
    from abuse_lens.streaming import features

    at = lambda *seconds: [packet(ts=(10**6 + s) * 10**9) for s in seconds]
    source = stream(spark, tmp_path, [at(0, 61), at(65, 250), at(600)], PACKETS, "idle")
    timed = windows.event_time(source, "ts_ns", "10 seconds")
    counted = timed.groupBy(F.window("event_time", "60 seconds").alias("span")).agg(F.count("*").alias("packets"))
    out = run(features.with_empty_windows(counted, "span", 60), tmp_path, "s_empty")
    first = 10**6 // 60 * 60
    got = {(r.window_start - first) // 60: r.packets for r in out.collect()}
    # the window of the last packet is still open; those before it have been timed
    assert got == {0: 1, 1: 2, 2: None, 3: None, 4: 1, 5: None, 6: None, 7: None, 8: None, 9: None}


def test_batch_counters_are_summed_from_their_table(spark, tmp_path):
    from abuse_lens.streaming import metrics

    batches = [[packet(ts=i * 10**9, wire=100 * i) for i in range(1, 6)], [packet(ts=i * 10**9, wire=100 * i) for i in range(6, 11)]]
    source = stream(spark, tmp_path, batches, PACKETS, "quality")
    counters = metrics.BatchCounters(spark, str(tmp_path / "counters"))
    spark.streams.addListener(counters)
    good = metrics.observed(source, F.when(F.col("wire_len") > 800, "too long"), F.when(F.col("wire_len") != 300, "in"))
    q = good.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp-q")).trigger(availableNow=True).start(str(tmp_path / "good"))
    q.awaitTermination()
    assert counters.wait(str(q.runId))
    spark.streams.removeListener(counters)
    rows = counters.read().collect()
    assert len(rows) == 2 and sum(r.events for r in rows) == 10 and sum(r.decode_errors for r in rows) == 2
    assert sum(r.events_filtered for r in rows) == 1 and spark.read.parquet(str(tmp_path / "good")).count() == 7


def test_batch_table_holds_each_batch_once(spark, tmp_path):
    """A batch without its manifest is not read and is written anew; one with its manifest is left alone."""
    from abuse_lens.sinks.batches import BatchTable

    table, schema = BatchTable(str(tmp_path / "out"), ["tag"]), "x bigint, tag string"
    rows = lambda *xs: spark.createDataFrame([(x, tag) for x in xs for tag in ("a", None)], schema)
    read = lambda: sorted((r.batch, r.x, r.tag or "") for r in table.read(spark, schema).collect())
    assert read() == [] and table.manifest(spark).isEmpty()
    table.put(rows(1), 0, "abandoned")
    assert read() == [] and not table.committed(spark, 0)
    table.write(rows(1, 2), 0)
    want = [(0, 1, ""), (0, 1, "a"), (0, 2, ""), (0, 2, "a")]
    assert read() == want
    table.write(rows(1, 2, 3), 0)
    table.write(rows().limit(0), 1)
    assert read() == want and table.committed(spark, 1)
    table.put(rows(9), 2, "abandoned")
    assert table.remove_abandoned(spark) == 1 and read() == want
    table.write(rows(4), 2)
    assert read() == [*want, (2, 4, ""), (2, 4, "a")]
    with pytest.raises(ValueError):
        table.write(rows(5).withColumnRenamed("x", "Batch"), 3)


def test_stream_restarts_after_a_lost_commit(spark, tmp_path):
    """Stopped between rows and manifest, in every batch once: all rows count exactly once."""
    from abuse_lens.sinks.batches import BatchTable

    lost = set()

    class Flaky(BatchTable):
        def commit(self, spark, batch, attempt):
            if batch not in lost:
                lost.add(batch)
                raise RuntimeError("driver lost")
            super().commit(spark, batch, attempt)

    for n in range(3):
        spark.range(n * 10, n * 10 + 10, 1, 1).selectExpr("id AS x", "CAST(id % 2 AS STRING) AS tag").write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("x bigint, tag string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table, failures = Flaky(str(tmp_path / "out"), ["tag"]), 0
    while True:
        try:
            table.start(source, str(tmp_path / "progress"), availableNow=True).awaitTermination()
            break
        except Exception:  # noqa: BLE001
            failures += 1
            assert failures <= 3
    assert failures == 3 and lost == {0, 1, 2}
    assert sorted(r.x for r in table.read(spark, "x bigint, tag string").collect()) == list(range(30))
    assert table.remove_abandoned(spark) == 3
    assert table.read(spark, "x bigint, tag string").count() == 30


class FakeStore:
    """State and timers of one key as a batch sees them; counts the calls."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, set()

    def getMapState(self, name, *schemas):
        return FakeState(self, self.states.setdefault(name, {}))

    getValueState = getMapState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class FakeState:
    def __init__(self, store, held):
        self.store, self.held = store, held

    def __getattribute__(self, name):
        if name in ("getValue", "updateValue", "removeKey", "keys", "get", "update", "clear", "iterator", "containsKey"):
            object.__getattribute__(self, "store").calls += 1
        return object.__getattribute__(self, name)

    def keys(self):
        return iter(list(self.held))

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def get(self):
        return self.held.get("")

    def update(self, value):
        self.held[""] = value

    def clear(self):
        self.held.clear()


def played(batches, idle_ms=10**9, slot_ms=100):
    """Rows (time, n) of one key through the processor, batch by batch with the watermark behind it: what it gives out, and the store."""
    from types import SimpleNamespace

    from abuse_lens.streaming.ordered import _InOrder

    take = lambda key, own, rows: ((len(rows) + (own[0] if own else 0),), [(*key, *r) for r in rows])
    close = lambda key, own: [(*key, -1, own[0])]
    store, out = FakeStore(), []
    steps = _InOrder(["k"], ["ts", "n"], "ts:bigint, n:bigint", 2, lambda r: r[0], take, close, idle_ms, slot_ms, ["k", "ts", "n"], "seen bigint")
    steps.init(store)
    for rows, watermark in batches:
        if rows:
            list(steps.handleInputRows((1,), iter([{"ts": t, "n": n} for t, n in rows]), None))
        for at in sorted(t for t in store.timers if t <= watermark):
            info = SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)
            given = steps.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), info)
            out.append([tuple(r)[1:] for r in given])
            store.timers.discard(at)
    return out, store


def test_calls_of_the_state_store_do_not_grow_with_rows():
    rows = [(100 * i + 5, i) for i in range(1000)]  # each in a slot of its own
    out, store = played([(rows[::-1], 0), ([], 10**6)])
    assert sum(out, []) == rows and store.calls < 60
    assert store.states["parts"] == {} and store.timers == {rows[-1][0] + 10**9}


@pytest.mark.parametrize("seed", range(4))
def test_rows_are_given_out_in_order_as_the_watermark_passes(seed):
    rng = random.Random(seed)
    batches, watermark, every = [], 0, []
    for i in range(30):
        rows = [(watermark + 1 + rng.randrange(3000), 100_000 * i + j) for j in range(rng.choice([0, 1, 40, 700]))]
        every += rows
        watermark += rng.choice([0, 10, 450, 2000])
        batches.append((rows, watermark))
    out, store = played(batches)
    whole = watermark // 100 * 100  # slots that the watermark has passed
    assert sum(out, []) == sorted(r for r in every if r[0] < whole)
    out, store = played([*batches, ([], 10**8)])
    assert sum(out, []) == sorted(every) and store.states["parts"] == {}


def test_an_idle_key_is_closed_once_and_forgotten():
    out, store = played([([(1000, 1)], 1200), ([(1900, 2)], 2050), ([], 2899), ([], 2950), ([(5000, 3)], 5100), ([], 9000)], idle_ms=1000)
    assert sum(out, []) == [(1000, 1), (1900, 2), (-1, 2), (5000, 3), (-1, 1)]
    assert not any(store.states.values()) and not store.timers
