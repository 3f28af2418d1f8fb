import pytest
from abuse_lens.config import ReportConfig, watched_ports
from abuse_lens.functions import net
from abuse_lens.operators import decisions as dec
from abuse_lens.operators import rules
from abuse_lens.sources import allowlist
from pyspark.sql import functions as F

CFG = ReportConfig(min_samples_for_fp=2)
TOTALS = (
    "key_ord int, ip_u32 bigint, key_type string, dst_port int, total_syn bigint, total_packets bigint, "
    "total_bytes bigint, syn_rate double, pkt_rate double, byte_rate double, success_ratio double"
)


def totals(spark, rows):
    full = [(0, ip, "src_ip", port, syn, pk, by, sr, pr, br, ratio) for ip, port, syn, pk, by, sr, pr, br, ratio in rows]
    return spark.createDataFrame(full, TOTALS)


@pytest.mark.parametrize(
    "syn, rates, expected",
    [
        (10, (100.0, 0.0, 0.0, 0.1), ("SYN_FLOOD_LIKE", "high")),
        (9, (100.0, 0.0, 0.0, 0.1), ("SYN_FLOOD_LIKE", "medium")),
        (9, (500.0, 1000.0, 0.0, 0.0), ("VOLUMETRIC_TCP_ABUSE", "medium")),
        (10, (500.0, 1000.0, 0.0, 0.0), ("SYN_FLOOD_LIKE", "high")),
        (100, (500.0, 0.0, 1e6, 0.9), ("VOLUMETRIC_TCP_ABUSE", "high")),
        (100, (500.0, 0.0, 0.0, 0.9), (None, "high")),
        (1, (1.0, 0.0, 0.0, 0.0), (None, "high")),
    ],
)
def test_abuse_class(spark, syn, rates, expected):
    r = dec.with_abuse(totals(spark, [(1, 80, syn, 1, 1, *rates)]), CFG).first()
    assert (r.detected_class, r.confidence) == expected


FLOOD = (200.0, 0.0, 0.0, 0.0)
CALM = (1.0, 0.0, 0.0, 0.9)


def decide(spark, rows, cfg=CFG, allow=()):
    listed = allowlist.from_lines(spark, list(allow)) if allow else allowlist.empty(spark)
    return dec.decide(totals(spark, rows), cfg, listed, 1000)


def test_allowlisted_is_never_blocked_and_not_counted(spark):
    d = decide(spark, [(1, 80, 100, 1000, 10, *FLOOD), (2, 80, 50, 100, 10, *CALM), (3, 80, 60, 300, 10, *FLOOD)], allow=["0.0.0.1"])
    rows = {r.ip_u32: (r.decision, r.abuse_class, r.until_ts) for r in d.collect()}
    assert rows == {1: ("allow", None, None), 2: ("allow", None, None), 3: ("block", "SYN_FLOOD_LIKE", 1300)}
    i = dec.counterfactual(d, CFG).first()
    assert (i.total_packets, i.blocked_packets, i.percent_packets_blocked) == (400, 300, 75.0)
    assert dec.analysed(d).first()[:] == (3, 1)
    assert {r.ip_u32 for r in dec.non_allowlisted(d).collect()} == {2, 3}


def test_fp_bound_unknown_zero_and_computed(spark):
    one = dec.counterfactual(decide(spark, [(1, 80, 100, 10, 1, *FLOOD)]), CFG).first()
    assert (one.fp_computed, one.fp_value_pct, one.fp_reason) == (False, None, "Insufficient data: 1 keys, need at least 2")
    calm = dec.counterfactual(decide(spark, [(1, 80, 1, 10, 1, *CALM), (2, 80, 1, 10, 1, *CALM)]), CFG).first()
    assert (calm.fp_computed, calm.fp_value_pct) == (True, 0.0)
    legit = (500.0, 1000.0, 0.0, 0.5)
    mixed = dec.counterfactual(decide(spark, [(1, 80, 100, 30, 1, *legit), (2, 80, 100, 70, 1, *FLOOD)]), CFG).first()
    assert mixed.fp_value_pct == 30.0


def test_empty_input_and_reasons_in_order(spark):
    i = dec.readiness(dec.counterfactual(decide(spark, []), CFG), CFG).first()
    assert i.reasons == [
        "False positive bound unknown: Insufficient data: 0 keys, need at least 2", "No abuse pattern detected", "No traffic observed"
    ]
    assert (i.percent_syn_blocked, i.is_safe) == (0.0, False)
    legit = (500.0, 1000.0, 0.0, 0.5)
    rows = [(1, 80, 1, 100, 1, *legit), (2, 80, 999, 1, 1, *CALM)]
    i = dec.readiness(dec.counterfactual(decide(spark, rows), CFG), CFG).first()
    assert i.reasons == ["False positive bound too high: 100.0%", "Minimal impact (<1% SYN blocked)"]


def test_top_offenders_order_and_cut(spark):
    rows = [(ip, port, syn, 1, 1, *FLOOD) for ip, port, syn in [(5, 80, 50), (4, None, 90), (4, 80, 90), (3, 80, 90), (9, 80, 10)]]
    top = dec.top_offenders(decide(spark, rows), CFG.with_(top_offenders=4)).collect()
    assert [(r.ip_u32, r.dst_port) for r in top] == [(3, 80), (4, None), (4, 80), (5, 80)]


ALLOW = ["10.0.0.5", "# c", "", "10.0.0.64/28", "192.168.7.77/16", " 0.0.0.9 "]


def test_allowlist_join_equals_python(spark):
    import ipaddress
    import random

    rng = random.Random(1)
    nets = [ipaddress.ip_network(x.strip(), strict=False) for x in ALLOW if x.strip() and not x.startswith("#")]
    ips = [rng.choice([167772160 + rng.randrange(120), 3232235776 + rng.randrange(400000), rng.randrange(2**32), 9]) for _ in range(500)]
    listed = allowlist.from_lines(spark, ALLOW)
    assert (listed.ip_count, listed.cidr_count, listed.prefixes) == (2, 2, (16, 28, 32))
    df = spark.createDataFrame([(i,) for i in ips], "ip_u32 bigint")
    expected = sorted((i, any(ipaddress.ip_address(i) in n for n in nets)) for i in ips)
    assert sorted((r.ip_u32, r.allowlisted) for r in allowlist.with_allow_flag(df, listed).collect()) == expected
    semi = {r.ip_u32 for r in allowlist.allowed_addresses(df, listed).collect()}
    assert semi == {i for i, inside in expected if inside}
    missing = spark.createDataFrame([(None,)], "ip_u32 bigint")
    assert [r.allowlisted for r in allowlist.with_allow_flag(missing, listed).collect()] == [False]


def test_allowlist_prefix_zero_matches_all(spark):
    listed = allowlist.from_lines(spark, ["1.2.3.4/0"])
    df = spark.createDataFrame([(1,), (2**32 - 1,)], "ip_u32 bigint")
    assert [r.allowlisted for r in allowlist.with_allow_flag(df, listed).collect()] == [True, True]


@pytest.mark.parametrize("line", ["10.0.0.300", "10.0.0.1/33", "10.0.0/8", "10.0.0.1/8/9", "host", "01.2.3.4", "10.0.0.1/"])
def test_allowlist_bad_line_fails(spark, line):
    with pytest.raises(Exception, match="malformed allowlist line"):
        allowlist.from_lines(spark, ["10.0.0.1", line])


def test_rules_dedupe_order_and_cidr_key(spark):
    schema = (
        "key_ord int, ip_u32 bigint, src_ip string, dst_port int, start_ts bigint, abuse_class string, max_syn_rate double, "
        "min_success_ratio double"
    )
    ep = spark.createDataFrame(
        [
            (0, 167772161, "10.0.0.1", 80, 200, "VOLUMETRIC_TCP_ABUSE", 9.0, 0.5),
            (0, 167772161, "10.0.0.1", 80, 100, "SYN_FLOOD_LIKE", 7.0, 0.1),
            (0, 167772161, "10.0.0.1", None, 50, None, 1.0, 0.0),
            (1, 167772416, "10.0.1.0", 80, 10, "SYN_FLOOD_LIKE", 2.0, 0.0),
            (0, 167772170, "10.0.0.10", 80, 10, "SYN_FLOOD_LIKE", 3.0, 0.0),
            (0, 167772162, "10.0.0.2", 80, 10, "SYN_FLOOD_LIKE", 3.0, 0.0),
        ],
        schema,
    )
    listed = allowlist.from_lines(spark, ["10.0.0.2"])
    got = rules.rules_from_episodes(ep, CFG, listed).orderBy(*rules.rule_order()).collect()
    assert [(r.key_type, r.key_value, r.dst_port, r.abuse_class, r.from_cidr24) for r in got] == [
        ("src_ip", "10.0.0.1", None, "UNKNOWN", False),
        ("src_ip", "10.0.0.1", 80, "SYN_FLOOD_LIKE", False),
        ("src_ip", "10.0.0.10", 80, "SYN_FLOOD_LIKE", False),
        ("src_ip", "10.0.1.0", 80, "SYN_FLOOD_LIKE", True),
    ]
    offenders = totals(spark, [(167772161, 80, 5, 1, 1, *FLOOD), (167772163, 80, 5, 1, 1, *FLOOD)])
    top = dec.top_offenders(dec.decide(offenders, CFG, listed, 0), CFG)
    shown = {r.source: (r.shown_syn_rate, r.shown_success_ratio) for r in rules.offender_rates(top, ep).collect()}
    assert shown == {"10.0.0.1:80": (7.0, 0.1), "10.0.0.3:80": (200.0, 0.0)}


def test_exceptions_order(spark):
    listed = allowlist.from_lines(spark, ["10.0.0.9", "9.0.0.10", "10.0.0.0/8", "10.0.0.0/9", "2.0.0.0/30"])
    got = allowlist.exceptions(listed).orderBy("rank", "network", "prefix_len").collect()
    assert [(r.key_type, r.key_value) for r in got] == [
        ("src_ip", "9.0.0.10"), ("src_ip", "10.0.0.9"), ("src_cidr", "2.0.0.0/30"), ("src_cidr", "10.0.0.0/8"), ("src_cidr", "10.0.0.0/9")
    ]


def test_display_key(spark):
    df = spark.createDataFrame([("src_ip", 167772161, 80), ("src_ip", 167772161, None), ("src_cidr24", 167772160, 80)], "t string, ip bigint, p int")
    got = [r[0] for r in df.select(net.display_key(F.col("t"), F.col("ip"), F.col("p"))).collect()]
    assert got == ["10.0.0.1:80", "10.0.0.1", "10.0.0.0/24"]


@pytest.mark.parametrize("ports, more", [([], []), ([80], [80]), ([0], []), ([70000], []), (list(range(1, 10)), [])])
def test_port_options_rejected(ports, more):
    with pytest.raises(ValueError):
        watched_ports(ports, more)


def test_port_options_merged():
    assert watched_ports([8080], [443, 22]) == (22, 443, 8080)
