import random
import statistics

import pytest
from abuse_lens.functions import hashing, http, net, timetext
from abuse_lens.operators import compare, host, packets, rpc, sampling, scrub
from pyspark.sql import functions as F

PACKETS = (
    "ts_ns bigint, direction string, ip_version int, proto int, src_ip bigint, dst_ip bigint, src_port int, dst_port int, "
    "syn boolean, ack boolean, rst boolean, payload_len bigint, wire_len bigint"
)


def packet(direction="ingress", src=1, dst=2, sport=5000, dport=80, syn=False, ack=False, rst=False, payload=0, wire=60, ts=0, v=4, proto=6):
    return (ts, direction, v, proto, src, dst, sport, dport, syn, ack, rst, payload, wire)


def test_both_directions_fill_one_bucket(spark):
    df = spark.createDataFrame(
        [
            packet(syn=True), packet(ack=True), packet(ack=True, payload=5), packet(syn=True, ack=True), packet(rst=True, ack=True),
            packet("egress", src=2, dst=1, sport=80, dport=5000, rst=True, wire=54),
            packet(dport=81), packet(v=6), packet(proto=17), packet("egress", src=1, dst=2, sport=5000, dport=80),
        ],
        PACKETS,
    )
    kept = packets.watched(df, [80, 443])
    (r,) = packets.both_counters(kept).collect()
    assert r.asDict() == {"ip_u32": 1, "dst_port": 80, "syn": 2, "ack": 4, "handshake_ack": 1, "rst": 2, "packets": 6, "bytes": 354}
    both = packets.ingress_counters(kept).unionByName(packets.egress_counters(kept)).groupBy("ip_u32", "dst_port").agg(F.sum("packets")).first()
    assert both[2] == 6


def test_packet_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([packet(), packet(dport=81)], PACKETS).write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    counted = packets.both_counters(packets.watched(table, [80])).select("ip_u32", "packets")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("ReadSchema")[0]
    # The plan text is cut off after the start of the port condition.
    assert "EqualTo(proto,6)" in pushed and "EqualTo(ip_version,4)" in pushed and "Or(EqualTo(src" in pushed
    assert "payload_len" not in plan.split("ReadSchema: ")[1].splitlines()[0]


def test_cumulative_and_interval_counters(spark):
    df = spark.createDataFrame([packet(ts=t * 10**9, syn=True) for t in (5, 61, 62, 300)], PACKETS)
    per = packets.interval_counters(df, 60)
    assert sorted((r.ts, r.syn) for r in per.collect()) == [(0, 1), (60, 2), (300, 1)]
    for width in (60, 120, 10**6):
        assert sorted((r.ts, r.syn) for r in packets.cumulative(per, width).collect()) == [(0, 1), (60, 3), (300, 4)]


def test_wall_clock_clamps(spark):
    df = spark.createDataFrame([(1_500_000_999,), (0,)], "ts_ns bigint")
    got = [tuple(r)[1:] for r in packets.wall_clock(df, packets.boot_anchor_ns(10, 1_000_000_000)).collect()]
    assert got == [(0, 500001), (0, 0)]
    df = spark.createDataFrame([(0, b""), (300, b"a" * 300), (10, b"b" * 10)], "wire_len bigint, pkt binary")
    assert [(r.cap_len, len(r.pkt)) for r in packets.snapped(df).collect()] == [(256, 256), (10, 10)]


def test_network_helpers(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("0.0.0.0",), ("255.255.255.255",), ("1.2.3",), ("1.2.3.256",), ("001.2.3.4",), (" 1.2.3.4",), (None,)], "t string")
    got = [tuple(r) for r in df.select(net.ipv4_to_long(F.col("t")).alias("n")).select("n", net.long_to_ipv4(F.col("n"))).collect()]
    assert got[:3] == [(167772161, "10.0.0.1"), (0, "0.0.0.0"), (4294967295, "255.255.255.255")]
    assert all(r == (None, None) for r in got[3:])
    assert spark.range(1).select(net.cidr24(F.lit(167772161).cast("bigint"))).first()[0] == 167772160


def test_flow_key_is_the_same_both_ways(spark):
    rows = [(2**32 - 1, 5, 65535, 80), (5, 2**32 - 1, 80, 65535), (7, 7, 2, 1)]
    df = spark.createDataFrame(rows, "src_ip bigint, dst_ip bigint, src_port int, dst_port int")
    got = [(r.flow_low, r.flow_high, r.direction) for r in rpc.directed(df, [80, 1]).collect()]
    assert got[0][:2] == got[1][:2] == (5 * 65536 + 80, (2**32 - 1) * 65536 + 65535)
    assert [g[2] for g in got] == ["to_server", "from_server", "to_server"]
    assert rpc.directed(df, [99]).count() == 0


def test_hash_and_scrub(spark):
    rng = random.Random(3)
    ips = [rng.randrange(2**32) for _ in range(200)]
    salt = "0123456789ABCDEF"
    df = spark.createDataFrame([(i,) for i in ips], "ip bigint")
    got = [r[0] for r in df.select(hashing.hash_ipv4(F.col("ip"), salt)).collect()]
    assert got == [hashing.fnv1a64(bytes.fromhex(salt) + i.to_bytes(4, "big")) & 0xFFFFFFFF for i in ips]
    tags = ["", "a", "incident-2024", "é_日本"]
    marks = spark.createDataFrame([(x,) for x in tags], "t string").select(hashing.tag_fingerprint(F.col("t"))).collect()
    assert [r[0] for r in marks] == [f"{hashing.fnv1a64(x.encode()):016x}" for x in tags]
    for bad in ("", "123", "0123456789ABCDEG", "0x23456789ABCDEF"):
        with pytest.raises(ValueError):
            hashing.parse_salt(bad)
    assert hashing.fnv1a64(b"") == 0xCBF29CE484222325 and hashing.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def frame(src, dst, ethertype="0800", tail="abcdef"):
    return bytes.fromhex("02" * 12 + ethertype + "45" + "00" * 11) + src.to_bytes(4, "big") + dst.to_bytes(4, "big") + bytes.fromhex(tail)


def test_scrub_frames(spark):
    inside, outside = 0x0A000001, 0x08080808
    rows = [(1, frame(inside, inside)), (2, frame(inside, outside)), (3, frame(inside, inside, "86dd")), (4, frame(inside, inside)[:33]), (5, b"")]
    df = spark.createDataFrame(rows, "i int, pkt binary")
    got = {r.i: bytes(r.pkt) for r in scrub.scrub_frames(df, salt="0" * 16, subnet="10.0.0.9/8").collect()}
    assert sorted(got) == [2, 3, 4, 5]
    h = lambda ip: hashing.fnv1a64(bytes(8) + ip.to_bytes(4, "big")) & 0xFFFFFFFF
    assert got[2] == frame(h(inside), h(outside)) and got[3] == rows[2][1] and got[4] == rows[3][1]
    assert scrub.scrub_frames(df, subnet="0.0.0.0/0").count() == 3
    assert scrub.scrub_frames(df, subnet="10.0.0.1/32").count() == 4
    assert scrub.scrub_frames(df).count() == 5
    for bad in ("10.0.0.0", "10.0.0.0/33", "10.0.0/8", "10.0.0.0/x"):
        with pytest.raises(ValueError):
            scrub.parse_subnet(bad)


PAIRS = (
    "w bigint, request_bytes bigint, response_bytes bigint, status_code int, req_started_ns bigint, resp_completed_ns bigint, "
    "rpc_envelope_parsed boolean, rpc_error_code int"
)


def features(spark, rows, ports=((1, 2),)):
    df = spark.createDataFrame(rows, PAIRS)
    ev = spark.createDataFrame([(1, s, d) for s, d in ports], "w bigint, src_port int, dst_port int")
    return rpc.response_aggregates(df, ev, ["w"]).first()


def pair(q, r, status=None, start=0, done=0, parsed=False, code=None):
    return (1, q, r, status, start, done, parsed, code)


def test_window_features_worked_case(spark):
    f = features(spark, [pair(100, 200), pair(50, 250), pair(200, 200)])
    assert (f["count"], f.resp_bytes_total, f.req_bytes_max, f.resp_bytes_max) == (3, 650, 200, 250)
    assert (f.amp_ratio_mean, f.amp_ratio_median, f.amp_ratio_max) == (pytest.approx(8 / 3), 2.0, 5.0)
    assert (f.status_2xx_frac, f.rpc_error_frac, f.duration_ns_max, f.duration_ns_mean) == (None,) * 4


def test_window_features_edges(spark):
    zero = features(spark, [pair(0, 10), pair(0, 20)])
    assert (zero.amp_ratio_mean, zero.amp_ratio_median, zero.amp_ratio_max) == (None,) * 3
    even = features(spark, [pair(10, 10), pair(10, 40), pair(0, 9)])
    assert even.amp_ratio_median == 2.5
    timed = features(spark, [pair(1, 1, start=5, done=10), pair(1, 1, start=5, done=5), pair(1, 1, start=0, done=4), pair(1, 1, start=9, done=1)])
    assert (timed.duration_ns_max, timed.duration_ns_mean) == (5, 4)
    st = features(spark, [pair(1, 1, s) for s in (200, 299, 404, 302, None)])
    assert (st.status_2xx_frac, st.status_4xx_frac, st.status_5xx_frac) == (0.5, 0.25, 0.0)
    err = features(spark, [pair(1, 1, parsed=True, code=c) for c in (1, 2, 3, 4, 5, 6, 6)] + [pair(1, 1, parsed=True), pair(1, 1, code=7)])
    assert (err.rpc_error_distinct_codes, err.rpc_error_frac) == (5, pytest.approx(7 / 9))
    none = features(spark, [pair(1, 1, parsed=True)])
    assert (none.rpc_error_distinct_codes, none.rpc_error_frac) == (0, 0.0)
    ports = features(spark, [pair(1, 1)], [(s, 80) for s in range(9)])
    assert (ports.unique_src_ports, ports.unique_dst_ports) == (5, 1)


def test_exact_median_matches_python(spark):
    rng = random.Random(9)
    rows = []
    for g in range(6):
        n = rng.randrange(1, 300)
        rows += [(g, rng.choice([0.0, 1.0, 2.0, rng.random() * 10 ** rng.randrange(-6, 6)])) for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.m for r in rpc.exact_median(df, ["g"], "v", "m").collect()}
    assert got == {g: statistics.median(v for k, v in rows if k == g) for g in range(6)}


def test_pairing(spark):
    q, s = "to_server", "from_server"
    turns = [s, q, q, s, s, q, s, q]
    rows = [(1, i, d, 10 + i, i, i, 200 if d == s else None, False, None) for i, d in enumerate(turns)]
    df = spark.createDataFrame(rows, "flow bigint, n int, direction string, body_len bigint, first_ts bigint, done_ts bigint, status int, rpc_parsed boolean, rpc_error_code int")
    for width in (1, 2, 100):
        got = rpc.pair_messages(df, ["flow"], ["n"], "n", width)
        assert sorted((r.request_bytes, r.response_bytes) for r in got.collect()) == [(12, 13), (15, 16)]


def test_host_deltas(spark):
    t = "2024-01-01 00:00:0{}"
    rows = [
        (1, t.format("0"), 100, 1000, 5, 7, 100), (1, t.format("2"), 300, 400, 9, 4, 50),
        (1, t.format("2.05"), 400, None, None, 4, 60), (1, t.format("4.05"), 100, 10, 1, None, None), (2, t.format("0"), 1, 1, 1, 1, 1),
    ]
    df = spark.createDataFrame(rows, "pid int, at string, cpu_jiffies bigint, rss_bytes bigint, num_fds bigint, num_connections bigint, io_write_bytes bigint")
    df = df.withColumn("captured_at", F.col("at").cast("timestamp_ntz"))
    for slice_sec in (1, 3, 1000):
        a, b, c = [tuple(r)[2:] for r in host.host_deltas(df, slice_sec).orderBy("captured_at").collect()]
        assert a == (100.0, 100.0, -600, 400, -300.0, 4, -3, 4, -50)
        assert b == (None, None, None, None, None, None, 0, 4, 10)
        assert c == (0.0, 0.0, None, None, None, None, None, None, None)


LOG = "ts bigint, seq bigint, action string, tag string, rate bigint, duration_sec bigint"


def test_regimes(spark):
    log = spark.createDataFrame(
        [
            (10, 0, "trigger", "a", 2, None), (20, 1, "set-sample-rate", None, 5, None), (25, 2, "set-sample-rate", None, 0, None),
            (30, 3, "stop", None, None, None), (40, 4, "trigger", "bad tag", 1, None), (50, 5, "trigger", "b", 3, 15),
            (60, 6, "set-sample-rate", None, 4, None), (90, 7, "status", None, None, None), (100, 8, "trigger", "c", 1, 5), (100, 9, "stop", None, None, None),
        ],
        LOG,
    )
    for width in (1, 15, 10**6):
        got = [tuple(r) for r in sampling.regimes(log, slice_sec=width).orderBy("start_ts").collect()]
        assert got == [
            (10, 20, True, 2, "a", 10), (20, 30, True, 5, "a", 10), (30, 50, False, 5, "a", 10), (50, 60, True, 3, "b", 50),
            (60, 65, True, 4, "b", 50), (65, 100, False, 4, "b", 50), (100, 2**62, False, 1, "c", 100),
        ]


def test_countdown_is_carried_over_regimes(spark):
    spans = [(0, 100, True, 4), (100, 200, True, 3), (200, 300, False, 3), (300, 400, True, 5)]
    rows, sampled, left = [], [], 2
    rng = random.Random(4)
    n = 0
    for s, e, active, rate in spans:
        for ts in sorted(rng.sample(range(s, e), 23)):
            rows.append((n, 0, ts, active, rate, s))
            if active:
                if left:
                    left -= 1
                else:
                    sampled.append(n)
                    left = rate - 1
            n += 1
    df = spark.createDataFrame(rows, "n int, cpu int, ts bigint, active boolean, rate bigint, start_ts bigint")
    for width in (7, 1000):
        got = sampling.sample_with_carry(df, "cpu", ["ts"], "ts", width, initial_rate=3)
        assert sorted(r.n for r in got.collect()) == sampled


def test_one_in_n(spark):
    df = spark.range(0, 50).select("id", (F.col("id") % 2).alias("cpu"))
    got = sampling.one_in_n(df, ["cpu"], ["id"], "id", 8, F.lit(5))
    assert sorted(r.id for r in got.collect()) == [8, 9, 18, 19, 28, 29, 38, 39, 48, 49]
    assert sampling.one_in_n(df, ["cpu"], ["id"], "id", 8, F.lit(0)).count() == 50


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "line_no int, value string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "line_no int, value string")
    got = sorted(tuple(r) for r in compare.multiset_diff(a, b).collect())
    assert got == [(1, "x", "expected", 1), (3, "z", "actual", 1)]
    assert compare.multiset_diff(a, a).count() == 0
    assert tuple(compare.first_difference(a.distinct(), b).first()) == (3, None, "z")


def test_clock_text_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            s = F.lit(1710054000).cast("bigint")
            r = spark.range(1).select(timetext.hour_name(s), timetext.run_dir_name(s), timetext.hour_seconds(F.lit("2024031007")), timetext.hour_seconds(F.lit("2024023100")), timetext.hour_seconds(F.lit("2024031002")),
                timetext.micros_from_ntz(F.expr("timestamp_ntz'1969-12-31 23:59:59.5'"))).first()
            assert tuple(r) == ("2024031007", "20240310-070000Z", 1710054000, None, 1710036000, -500000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_head_columns(spark):
    rows = [(b"HTTP/1.1 404 X\r\ncontent-LENGTH:  12 \r\n\r\nabc",), (b"POST / HTTP/1.1\r\nA: b\r\n\r\n",), (b"POST / HTTP",), (b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\n",)]
    df = spark.createDataFrame(rows, "p binary")
    got = [tuple(r) for r in df.select(http.head_length(F.col("p")), http.content_length(F.col("p")), http.status_code(F.col("p"))).collect()]
    assert got == [(40, 12, 404), (25, 0, None), (None, 0, None), (38, 0, 200)]
    bodies = ['{"jsonrpc":"2.0","error":{"code":-32000}}', '{"jsonrpc":"2.0"}', '{"id":1}', "x"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [tuple(r[0]) for r in df.select(http.rpc_envelope(F.col("b"))).collect()]
    assert got == [(True, -32000), (True, None), (False, None), (False, None)]
