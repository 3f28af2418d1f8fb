import json
import random

import pytest
from abuse_lens.operators import packets, quality
from abuse_lens.sinks import files, incidents, retention
from abuse_lens.sinks import snapshots as sink
from abuse_lens.sources import allowlist, snapshots
from helpers import bucket, counter, counters, lines, snapshot
from pyspark.sql import functions as F

GOOD = bucket("10.0.0.1", 1, 1, 1, 0, 2, 200)


def without(d, name):
    return {k: v for k, v in d.items() if k != name}


@pytest.mark.parametrize(
    "line, reason",
    [
        ("not json", "malformed JSON"),
        ('{"version":7', "malformed JSON"),
        (snapshot(1, [GOOD], version=4), "unsupported version"),
        (snapshot(1, [GOOD], version=8), "unsupported version"),
        (without(snapshot(1, [GOOD]), "run_id"), "missing field"),
        (snapshot(1, [without(GOOD, "syn")]), "missing bucket field"),
        (snapshot(1, [GOOD, {**GOOD, "extra": 1}]), "unknown bucket field"),
        (json.dumps(snapshot(1, [GOOD])).replace('"rst": 0', '"rst": 0, "rst": 0'), "duplicate bucket field"),
        (snapshot(1, [{**GOOD, "src_ip": "999.0.0.1"}]), "invalid IP address"),
        (snapshot(1, [{**GOOD, "syn": 2**32}]), "bucket value out of range"),
        (snapshot(1, [{**GOOD, "dst_port": 65536}]), "bucket value out of range"),
        (snapshot(1, [{**GOOD, "key_type": "dst_ip"}]), "unknown key type"),
        (snapshot(1, [{**GOOD, "packets": 1.0}]), "malformed JSON"),
        (json.dumps(snapshot(1, [GOOD])).replace('"run_id"', '"run_id": 1, "run_id"'), "duplicate field"),
        (snapshot(1, [GOOD]) | {"resp_aggregates": {"count": 1}}, "missing field"),
        (snapshot(-1, [GOOD]), "value out of range"),
        (snapshot(1, [GOOD], ports=[70000]), "value out of range"),
    ],
)
def test_one_bad_line_is_quarantined(spark, line, reason):
    text = lines(spark, [line, "", "   ", snapshot(5, [GOOD])])
    parsed = snapshots.parse(text)
    assert [r.reason for r in parsed.bad.collect()] == [reason]
    assert [r.ts_unix_sec for r in parsed.good.collect()] == [5]
    with pytest.raises(Exception, match=reason):
        snapshots.parse_strict(text).collect()


def test_versions_optional_blocks_and_unknown_top_fields(spark):
    host = {"cpu_mean": 1.5, "rss_delta": -3}
    resp = {"count": 2, "resp_bytes_total": 9, "amp_ratio_mean": 0.5}
    items = [snapshot(1, [], version=5), snapshot(2, [GOOD], version=6) | {"note": [1]}, snapshot(3, []) | {"host": host, "resp_aggregates": resp}]
    got = {r.ts_unix_sec: r for r in snapshots.parse_strict(lines(spark, items)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[3].host.rss_delta, got[3].host.num_fds_delta, got[3].resp_aggregates["count"]) == (-3, None, 2)
    assert got[1].host is None


def test_directory_scan_header_and_files(spark, tmp_path):
    def put(name, items):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(json.dumps(i) + "\n" for i in items))

    put("snapshot_2024010203.jsonl", [snapshot(1704164400, [{**GOOD, "dst_port": 443}], run_id=9, interval=30), snapshot(1704164460, [GOOD])])
    put("snapshot_2024010202.jsonl", [snapshot(1704160800, [without(GOOD, "dst_port")], version=6, run_id=4, interval=15, ports=[22])])
    put("status.jsonl", [{"timestamp": 1, "cycle": 1, "ips_collected": 1, "snapshots_written": 1}])
    put("notes.txt", [snapshot(1, [GOOD])])
    put("sub/snapshot_2024010209.jsonl", [snapshot(2, [GOOD])])
    scanned = snapshots.read_lines(spark, str(tmp_path))
    parsed = snapshots.parse(scanned)
    h = snapshots.run_header(parsed.good).first()
    assert (h.start_ts, h.end_ts, h.duration_sec, h.version_min, h.version_max) == (1704160800, 1704164460, 3660, 6, 7)
    assert (h.run_id, h.interval_sec, list(h.ports)) == (4, 15, [22, 443, 8080])
    assert parsed.bad.count() == 1  # the heartbeat line
    assert [r.hour_ts for r in snapshots.snapshot_files(scanned).collect()] == [1704160800, 1704164400]
    assert snapshots.between(parsed.good, 1704160800, 1704164400).count() == 2
    ports = sorted(r.port for r in snapshots.ports_present(parsed.good).collect())
    assert ports == [22, 443, 8080]
    empty = snapshots.run_header(parsed.good.where("false")).first()
    assert (empty.start_ts, empty.run_id, empty.interval_sec, list(empty.ports)) == (None, 0, 60, [])


def test_counter_rows(spark):
    b = [{**GOOD, "key_type": "src_cidr24", "src_ip": "10.0.0.0"}, without(GOOD, "dst_port")]
    rows = snapshots.counter_rows(snapshots.parse(lines(spark, [snapshot(7, b)])).good).orderBy("seq").collect()
    assert [(r.key_type, r.key_ord, r.ip_u32, r.dst_port) for r in rows] == [("src_cidr24", 1, 167772160, 8080), ("src_ip", 0, 167772161, None)]


def test_what_a_line_holds_is_not_copied_for_its_buckets(spark):
    """One row a line has its text and header ports; the explode passes on neither, and the digest is made below it."""
    items = [snapshot(7, [{**GOOD, "syn": i} for i in range(40)], ports=[22, 443]), snapshot(9, [], ports=[5])]
    good = snapshots.parse(lines(spark, items)).good
    flat = snapshots.flattened(good)
    got = flat.collect()
    assert sorted((r.ts_unix_sec, r.text is None, list(r.dst_ports or [])) for r in got if r.pos is None) == [(7, False, [22, 443]), (9, False, [5])]
    assert [r.syn for r in sorted((r for r in got if r.pos is not None), key=lambda r: r.pos)] == list(range(40))
    assert all(r.text is None and r.dst_ports is None for r in got if r.pos is not None)
    assert [r.seq[-11:] for r in snapshots.counter_rows(good).orderBy("seq").collect()] == [f"#{i:010d}" for i in range(40)]
    plan = snapshots.counter_rows(good)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    explodes = next(i for i, line in enumerate(plan) if "Generate" in line and "explode" in line)
    assert not any("md5(" in line for line in plan[:explodes]) and any("md5(" in line for line in plan[explodes:])
    columns = plan[explodes + 1]  # what stands below it, and so beside the array
    assert "rows#" in columns and "value#" not in columns.split("md5")[0]


def test_assembled_snapshots_sort_buckets_and_split_when_large(spark):
    data = [counter(60, i, ip=ip, port=p, ord_=o) for i, (o, ip, p) in enumerate([(1, 5, 80), (0, 9, 80), (0, 9, None), (0, 2**32 - 1, 1), (0, 3, 443)])]
    whole = packets.assemble_snapshots(counters(spark, data), (443, 80), 60, 1, 0)
    (text,) = [json.loads(r.value) for r in packets.snapshot_json(whole).collect()]
    keys = [(b["key_type"], b["src_ip"], b.get("dst_port")) for b in text["buckets"]]
    assert keys == [("src_ip", "0.0.0.3", 443), ("src_ip", "0.0.0.9", None), ("src_ip", "0.0.0.9", 80), ("src_ip", "255.255.255.255", 1), ("src_cidr24", "0.0.0.5", 80)]
    assert text["dst_ports"] == [80, 443] and "host" not in text and text["version"] == 7
    parts = packets.assemble_snapshots(counters(spark, data), (80,), 60, 1, 0, parts=2)
    sizes = [len(json.loads(r.value)["buckets"]) for r in packets.snapshot_json(parts).collect()]
    assert sum(sizes) == 5 and len(sizes) > 1


def test_hourly_append_read_and_rotate(spark, tmp_path):
    root = str(tmp_path / "snaps")
    data = [counter(1704160800 + 1800 * i, i + 1) for i in range(6)]
    snaps = packets.assemble_snapshots(counters(spark, data), (8080,), 1800, 1, 0)
    sink.append(snaps.where("ts_unix_sec < 1704164400"), root)
    sink.append(snaps.where("ts_unix_sec >= 1704164400"), root)
    assert files.partition_values(spark, root, "hour") == ["2024010202", "2024010203", "2024010204"]
    back = snapshots.counter_rows(snapshots.parse_strict(sink.read_hourly(spark, root)))
    assert sorted((r.ts, r.syn) for r in back.collect()) == [(d[0], d[7]) for d in data]
    assert sink.read_hourly(spark, root, "2024010203", "2024010203").count() == 2
    now = 1704160800 + 3 * 3600
    assert sink.rotate(spark, root, now, max_age_sec=2 * 3600, max_files=1) == {"removed_by_age": 1, "removed_by_count": 1}
    assert files.partition_values(spark, root, "hour") == ["2024010204"]
    assert sink.rotate(spark, str(tmp_path / "none"), now) == {"removed_by_age": 0, "removed_by_count": 0}


def test_run_counters_do_not_depend_on_parts(spark):
    data = [counter(ts, i, ip=i) for ts in (60, 120) for i in range(50)]
    for parts in (1, 7):
        snaps = packets.assemble_snapshots(counters(spark, data), (80,), 60, 1, 0, parts=parts)
        assert tuple(quality.collection_result(snaps).first()) == (1, 2, 100, 2)
        assert sorted(tuple(r) for r in quality.heartbeats(snaps).collect()) == [(60, 1, 50, 1), (120, 2, 50, 2)]


def test_retention_of_equal_times(spark):
    df = spark.createDataFrame([("a", 10), ("b", 10), ("c", 9)], "name string, ts bigint")
    for most, kept in ((1, {"b"}), (2, {"a", "b"}), (3, {"a", "b", "c"}), (9, {"a", "b", "c"})):
        rows = retention.verdicts(df, "ts", 10, 100, most).collect()
        assert len(rows) == 3 and {r.name for r in rows if r.verdict == "kept"} == kept


def test_retention_boundaries(spark):
    df = spark.createDataFrame([(i,) for i in range(0, 1000, 100)], "ts bigint")
    got = {r.ts: r.verdict for r in retention.verdicts(df, "ts", 1000, max_age_sec=700, max_files=3).collect()}
    assert got[200] == "removed_by_age" and got[300] == "removed_by_count"
    assert [t for t, v in sorted(got.items()) if v == "kept"] == [700, 800, 900]


def test_status_files(spark, tmp_path):
    path = str(tmp_path / "status")
    data = [counter(60 * i, 1, ip=ip) for i in range(3) for ip in range(i + 1)]
    beats = quality.heartbeats(packets.assemble_snapshots(counters(spark, data), (80,), 60, 1, 0))
    sink.append_status(beats, path)
    got = [tuple(r) for r in sink.read_status(spark, path).orderBy("cycle").collect()]
    assert got == [(0, 1, 1, 1), (60, 2, 2, 2), (120, 3, 3, 3)]
    line = quality.incident_status(spark.createDataFrame([(5, 2, 7, 1)], "timestamp bigint, cycle bigint, events_written bigint, poll_errors bigint")).first().value
    assert line.startswith('{"timestamp":5,"cycle":2,"events_written":7,"events_decode_errors":0,') and json.loads(line)["poll_errors"] == 1
    assert len(json.loads(line)) == 11


def test_incident_segments_and_archive(spark, tmp_path):
    root, gone = str(tmp_path / "inc"), str(tmp_path / "arc")
    df = spark.range(0, 100, 1, 2).select(
        F.col("id").alias("ts_ns"), F.lit(b"x" * 84).alias("pkt"),
        F.when(F.col("id") < 60, "a").otherwise("b").alias("incident_tag"), F.lit(5).cast("bigint").alias("trigger_ts"),
    )
    incidents.write(df, root, max_bytes=1000)
    assert len(list((tmp_path / "inc" / "incident_tag=a" / "trigger_ts=5").glob("*.parquet"))) >= 6
    import time

    now = int(time.time())
    assert incidents.archive(spark, root, gone, now, 3600) == incidents.ArchiveResult(0, 0)
    assert incidents.archive(spark, root, gone, now + 7200, 3600) == incidents.ArchiveResult(2, 0)
    assert files.partition_values(spark, root, "incident_tag") == [] or not list((tmp_path / "inc").rglob("*.parquet"))
    assert spark.read.parquet(gone).groupBy("incident_tag").count().orderBy("incident_tag").collect()[0][:] == ("a", 60)
    assert list((tmp_path / "arc").rglob("*.gz.parquet"))
    assert incidents.archive(spark, root, gone, now + 7200, 3600) == incidents.ArchiveResult(0, 0)
    incidents.write(df.where("incident_tag = 'a'").withColumn("incident_tag", F.lit("a b%c")).union(df.where("incident_tag = 'b'")), root)
    assert incidents.archive(spark, root, gone, now + 7200, 3600) == incidents.ArchiveResult(2, 0)
    rows = spark.read.parquet(gone).groupBy("incident_tag").count().collect()
    assert sorted(tuple(r) for r in rows) == [("a", 60), ("a b%c", 60), ("b", 80)]
    assert incidents.archive(spark, str(tmp_path / "none"), gone, now, 1) == incidents.ArchiveResult(0, 0)


def greedy(sizes, max_bytes):
    """Brute force: one record after the other, the segment is over once it holds ``max_bytes``."""
    out, held, segment = [], 0, 0
    for size in sizes:
        out.append(segment)
        held += size
        if held >= max_bytes:
            held, segment = 0, segment + 1
    return out


@pytest.mark.parametrize("width, max_bytes", [(1, 300), (7, 300), (7, 1), (40, 5000), (10**6, 300), (3, 10**9)])
def test_segments_by_bytes(spark, width, max_bytes):
    rng = random.Random(width * max_bytes)
    rows, expected = [], {}
    for tag, ts, n in [("a", 1, 150), ("a", 2, 1), ("b", 1, 40), (None, 1, 30), ("b", None, 25)]:
        times = sorted(rng.choice([-400, -3, 0, 5, 900, rng.randrange(-60, 700)]) for _ in range(n))
        pkts = [rng.choice([None, b"", b"x" * rng.randrange(1, 200), b"y" * rng.choice([1, 2000])]) for _ in range(n)]
        numbers = greedy([16 + len(p or b"") for p in pkts], max_bytes)
        for i, (at, pkt, number) in enumerate(zip(times, pkts, numbers)):
            rows.append((tag, ts, at, i, pkt))
            expected[(tag, ts, i)] = number
    rng.shuffle(rows)
    packets = spark.createDataFrame(rows, "incident_tag string, trigger_ts bigint, at bigint, i int, pkt binary")
    got = incidents.segments(packets, ["at", "i"], "at", width, max_bytes)
    assert got.columns == [*packets.columns, "segment"]
    found = [((r.incident_tag, r.trigger_ts, r.i), r.segment) for r in got.collect()]
    assert len(found) == len(rows) and dict(found) == expected


def test_segments_of_nothing_and_written_ones(spark, tmp_path):
    schema = "incident_tag string, trigger_ts bigint, at bigint, i int, pkt binary"
    assert incidents.segments(spark.createDataFrame([], schema), ["at", "i"], "at", 10, 100).collect() == []
    with pytest.raises(ValueError):
        incidents.segments(spark.createDataFrame([], schema), ["at", "i"], "at", 10, 0)
    rows = [(tag, 5, i, i, b"x" * (i % 90)) for tag in "ab" for i in range(80)]
    root, gone = str(tmp_path / "seg"), str(tmp_path / "arc")
    incidents.write_segments(spark.createDataFrame(rows, schema), root, ["at", "i"], "at", 10, 500)
    back = spark.read.parquet(root).select("incident_tag", "i", "segment").collect()
    numbers = greedy([16 + i % 90 for i in range(80)], 500)
    assert sorted((r.incident_tag, r.i, r.segment) for r in back) == [(tag, i, numbers[i]) for tag in "ab" for i in range(80)]
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "seg").rglob("segment=*"))
    import time

    assert incidents.archive(spark, root, gone, int(time.time()) + 7200, 3600) == incidents.ArchiveResult(2, 0)
    assert not list((tmp_path / "seg").rglob("*.parquet")) and not list((tmp_path / "seg").rglob("segment=*"))
    assert spark.read.parquet(gone).count() == 160


def test_written_segments_are_read_trigger_by_trigger(spark, tmp_path):
    """No reader is given the files of two triggers, and all of them are read: odd tags and null keys too."""
    schema = "incident_tag string, trigger_ts bigint, at bigint, i int, pkt binary"
    triggers = [("a", 5), ("a", 6), ("b{1}*", 5), (None, 5), ("a", None)]
    rows = [(*k, i, i, b"x" * (i % 90)) for k in triggers for i in range(40)]
    root, asked = str(tmp_path / "seg"), []
    incidents.write_segments(spark.createDataFrame(rows, schema), root, ["at", "i"], "at", 10, 500)

    def work(back):
        asked.append(sorted(back.select("incident_tag", "trigger_ts").distinct().collect(), key=repr))
        return back.groupBy("incident_tag", "trigger_ts", "segment").agg(F.count(F.lit(1)).alias("n"))

    got = incidents.per_trigger(spark, root, f"{schema}, segment bigint", work).collect()
    numbers = greedy([16 + i % 90 for i in range(40)], 500)
    want = [(*k, s, numbers.count(s)) for k in triggers for s in set(numbers)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert max(map(len, asked)) == 1 and sum(map(len, asked)) == len(triggers)
    assert incidents.per_trigger(spark, str(tmp_path / "none"), f"{schema}, segment bigint", work).collect() == []


@pytest.mark.parametrize("block", [None, 200, 64])
def test_bad_lines_have_a_place_in_their_file(spark, tmp_path, block):
    """Files that are split into blocks, blank lines, files without a bad line and empty files."""
    rng, expected = random.Random(7), []
    for name, n in [("a.jsonl", 60), ("b.jsonl", 1), ("c.jsonl", 25), ("d.jsonl", 0)]:
        kinds = [rng.choice(["", "   ", "oops", "{}", '{"version": 5']) for _ in range(n)]
        expected += [(f"{name}:{i + 1}", kind) for i, kind in enumerate(kinds) if kind.strip()]
        (tmp_path / name).write_text("".join(k + "\n" for k in kinds))
    (tmp_path / "hour=2024010100").mkdir()
    (tmp_path / "hour=2024010100" / "part-0.txt").write_text("\n\nbad")
    expected.append(("part-0.txt:3", "bad"))
    setting = "spark.sql.files.maxPartitionBytes"
    if block:
        spark.conf.set(setting, str(block))
    try:
        read = snapshots.read_lines(spark, str(tmp_path), places=True)
        found = snapshots.located(snapshots.parse(read).bad, read)
        assert sorted((r.location, r.value) for r in found.collect()) == sorted(expected)
        assert set(found.columns) == {"file", "file_name", "value", "reason", "line", "location"}
    finally:
        spark.conf.unset(setting)


def test_allowlist_file(spark, tmp_path):
    (tmp_path / "allow.txt").write_text("# c\n10.0.0.1\n\n10.1.0.0/16\n")
    listed = allowlist.load(spark, str(tmp_path / "allow.txt"))
    assert (listed.ip_count, listed.cidr_count) == (1, 1)


def test_quarantine_rules(spark):
    df = spark.createDataFrame(
        [(0, 300, 256), (1, 100, 101), (2, 100, 50), (0, 300, 257), (None, 9, 1), (1, 5, 5)], "direction int, wire_len bigint, cap_len int"
    )
    good, bad = quality.good_and_bad(df, quality.packet_defect())
    assert sorted(tuple(r) for r in good.collect()) == [(0, 300, 256), (1, 5, 5)]
    assert sorted(r.defect for r in bad.collect()) == ["cap_len over 256", "cap_len over wire_len", "unknown direction", "unknown direction"]
    df = spark.createDataFrame([(0, 4, b"abcd"), (1, 1025, b"a"), (3, 0, b""), (0, 5, b"abcd")], "direction int, sample_len int, payload binary")
    good, bad = quality.good_and_bad(df, quality.payload_defect())
    assert good.count() == 1 and bad.count() == 3


def test_payload_snapshots(spark):
    from abuse_lens.operators import host, rpc
    from abuse_lens.plans.payload import payload_snapshots

    pairs = spark.createDataFrame(
        [(0, 100, 200, 200, 5, 9, True, -1), (0, 50, 250, None, 5, 5, False, None), (180, 1, 1, 404, 1, 2, False, None)],
        "w bigint, request_bytes bigint, response_bytes bigint, status_code int, req_started_ns bigint, resp_completed_ns bigint, "
        "rpc_envelope_parsed boolean, rpc_error_code int",
    )
    seen = spark.createDataFrame([(0, 1, 80), (0, 2, 80), (60, 3, 80)], "w bigint, src_port int, dst_port int")
    samples = spark.createDataFrame([(1, 0, 10, 5), (1, 60, 40, 9)], "pid int, s bigint, cpu_jiffies bigint, rss_bytes bigint")
    empty = F.lit(None).cast("bigint")
    samples = samples.withColumns({"captured_at": F.timestamp_seconds("s"), "num_fds": empty, "num_connections": empty, "io_write_bytes": empty})
    told = host.host_deltas(samples).withColumn("w", F.lit(60).cast("bigint"))
    rows = payload_snapshots(rpc.response_aggregates(pairs, seen, ["w"]), "w", 60, [80], 7, 0, told)
    got = {r.ts: json.loads(r.value) for r in packets.snapshot_json(rows).collect()}
    assert sorted(got) == [60, 120, 180, 240]
    assert got[60]["resp_aggregates"] == {
        "count": 2, "resp_bytes_total": 450, "req_bytes_max": 100, "resp_bytes_max": 250, "amp_ratio_mean": 3.5, "amp_ratio_median": 3.5,
        "amp_ratio_max": 5.0, "unique_dst_ports": 1, "unique_src_ports": 2, "duration_ns_mean": 4, "duration_ns_max": 4, "status_2xx_frac": 1.0,
        "status_4xx_frac": 0.0, "status_5xx_frac": 0.0, "rpc_error_distinct_codes": 1, "rpc_error_frac": 0.5, "req_bytes_mean": 75.0,
        "resp_bytes_mean": 225.0,
    }
    assert got[120]["host"] == {"cpu_mean": 0.5, "cpu_max": 0.5, "rss_delta": 4, "rss_max": 9, "rss_slope_bps": 4 / 60}
    assert "resp_aggregates" not in got[120] and "host" not in got[60] and got[180]["buckets"] == []
    lines_ = packets.snapshot_json(rows).select("value")
    assert snapshots.parse_strict(lines_).count() == 4
