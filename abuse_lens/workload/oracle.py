"""SQL twins of the registered queries, for the same parquet tables."""

from __future__ import annotations

from abuse_lens.functions.hashing import LOW_32, fnv1a64, parse_salt
from abuse_lens.workload import tables as t
from abuse_lens.workload.queries import METER_CFG, NOW, PER_DAY

D = t.DAY
DAY_NS = D * 1_000_000_000
SEED = fnv1a64(parse_salt(t.SALT)) & LOW_32
C6 = ("syn", "ack", "handshake_ack", "rst", "packets", "bytes")


def f(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


PK = f"""
raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 5 = 4 AS out FROM events),
ends AS (
  SELECT *, {t.CLIENT_NET} + user_id AS client_ip, {t.SERVER_NET} + 1 + k % 4 AS server_ip,
    CAST(40000 + event_id % 1000 AS INTEGER) AS client_port,
    CAST(CASE WHEN k = 97 THEN 9000 ELSE 8000 + k % 2 END AS INTEGER) AS server_port FROM raw),
pk AS (
  SELECT event_id, k, epoch_us(ts) * 1000 AS ts_ns, CASE WHEN out THEN 'egress' ELSE 'ingress' END AS direction,
    CASE WHEN k = 98 THEN 6 ELSE 4 END AS ip_version, CASE WHEN k = 99 THEN 17 ELSE 6 END AS proto,
    CASE WHEN out THEN server_ip ELSE client_ip END AS src_ip, CASE WHEN out THEN client_ip ELSE server_ip END AS dst_ip,
    CASE WHEN out THEN server_port ELSE client_port END AS src_port,
    CASE WHEN out THEN client_port ELSE server_port END AS dst_port,
    event_type = 'error' AS syn, event_type IN ('signup', 'click', 'view') AS ack, event_type = 'purchase' AS rst,
    CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS payload_len,
    CAST(round(value * 100) AS BIGINT) AS wire_len, CAST(user_id % 4 AS INTEGER) AS cpu FROM ends),
"""
W = PK + """
w AS (
  SELECT *, CASE WHEN direction = 'egress' THEN dst_ip ELSE src_ip END AS peer,
    CASE WHEN direction = 'egress' THEN src_port ELSE dst_port END AS port,
    ack AND NOT syn AND NOT rst AND payload_len = 0 AS hs FROM pk
  WHERE ip_version = 4 AND proto = 6
    AND CASE WHEN direction = 'egress' THEN src_port ELSE dst_port END IN (8000, 8001)),
"""
SUMS = """CAST(sum(CAST(syn AS BIGINT)) AS BIGINT) AS syn, CAST(sum(CAST(ack AS BIGINT)) AS BIGINT) AS ack,
    CAST(sum(CAST(hs AS BIGINT)) AS BIGINT) AS handshake_ack, CAST(sum(CAST(rst AS BIGINT)) AS BIGINT) AS rst,
    count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes"""
KEYS = "peer AS ip_u32, port AS dst_port"
DAILY = W + f"""
daily AS (
  SELECT {KEYS}, ts_ns // {DAY_NS} * {D} AS ts, {SUMS} FROM w GROUP BY ALL),
"""
OVER = "OVER (PARTITION BY ip_u32, dst_port ORDER BY ts)"
CUM = DAILY + "cum AS (SELECT ts, ip_u32, dst_port, " + ", ".join(
    f"CAST(sum({c}) {OVER} AS BIGINT) AS {c}" for c in C6
) + " FROM daily),\n"
DELTA = CUM + f"lagged AS (SELECT *, lag(ts) {OVER} IS NULL AS first, " + ", ".join(
    f"lag({c}) {OVER} AS p_{c}" for c in C6
) + " FROM cum),\ndelta AS (SELECT *, " + ", ".join(
    f"CASE WHEN p_{c} IS NOT NULL THEN greatest({c} - p_{c}, 0) END AS d_{c}" for c in C6
) + " FROM lagged),\n"


def totals(raw: bool) -> str:
    grown = lambda c: f"CAST(sum(coalesce(d_{c}, {c})) AS BIGINT) AS total_{c}"
    where = "" if raw else "WHERE NOT first"
    w = t.CFG.window_sec
    return DELTA + f"""
tot AS (SELECT ip_u32, dst_port, {", ".join(grown(c) for c in C6)} FROM delta {where} GROUP BY ALL),
stats AS (SELECT *, total_syn / {f(w)} AS syn_rate, total_packets / {f(w)} AS pkt_rate, total_bytes / {f(w)} AS byte_rate,
  CASE WHEN total_syn > 0 THEN CAST(total_handshake_ack AS DOUBLE) / total_syn ELSE 0.0::DOUBLE END AS success_ratio FROM tot),
"""


TOTALS = "ip_u32, dst_port, total_syn, total_ack, total_rst, total_packets, total_bytes, syn_rate, success_ratio"
IV = DELTA + f"""
iv AS (SELECT ts, ip_u32, dst_port, {", ".join(f"d_{c} AS {c}" for c in C6)},
  d_syn / {f(D)} AS syn_rate, d_packets / {f(D)} AS pkt_rate, d_bytes / {f(D)} AS byte_rate,
  CASE WHEN d_syn > 0 THEN CAST(d_handshake_ack AS DOUBLE) / d_syn ELSE 0.0::DOUBLE END AS success_ratio
  FROM delta WHERE NOT first),
"""


def hits(cfg, s="syn_rate", p="pkt_rate", b="byte_rate") -> str:
    return (
        f"(CAST({s} >= {f(cfg.vol_syn_rate)} AS INTEGER) + CAST({p} >= {f(cfg.vol_pkt_rate)} AS INTEGER)"
        f" + CAST({b} >= {f(cfg.vol_byte_rate)} AS INTEGER))"
    )


def flood(cfg, s="syn_rate", r="success_ratio") -> str:
    return f"({s} >= {f(cfg.syn_rate_threshold)} AND {r} <= {f(cfg.success_ratio_threshold)})"


def ip_text(x: str) -> str:
    return f"(({x} >> 24) & 255) || '.' || (({x} >> 16) & 255) || '.' || (({x} >> 8) & 255) || '.' || ({x} & 255)"


def episodes(cfg) -> str:
    m = ("max_syn_rate", "max_pkt_rate", "max_byte_rate")
    return IV + f"""
marked AS (SELECT *, {flood(cfg)} OR {hits(cfg)} >= 2 AS hot FROM iv),
runs AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END)
  OVER (PARTITION BY ip_u32, dst_port ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked),
ep0 AS (SELECT ip_u32, dst_port, run, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS interval_count,
  max(syn_rate) AS max_syn_rate, max(pkt_rate) AS max_pkt_rate, max(byte_rate) AS max_byte_rate,
  coalesce(min(CASE WHEN syn > 0 THEN success_ratio END), 0.0::DOUBLE) AS min_success_ratio,
  CAST(sum(syn) AS BIGINT) AS total_syn, CAST(sum(packets) AS BIGINT) AS total_packets, CAST(sum(bytes) AS BIGINT) AS total_bytes
  FROM runs WHERE hot GROUP BY ip_u32, dst_port, run),
ep AS (SELECT *, {ip_text("ip_u32")} AS src_ip, end_ts - start_ts + {D} AS duration_sec, CAST({D} AS BIGINT) AS interval_sec,
  CASE WHEN interval_count = 1 THEN 'single_window' ELSE 'multi_window' END AS episode_type,
  CASE WHEN {flood(cfg, "max_syn_rate", "min_success_ratio")} THEN 'SYN_FLOOD_LIKE'
       WHEN {hits(cfg, *m)} >= 2 THEN 'VOLUMETRIC_TCP_ABUSE' END AS abuse_class
  FROM ep0 WHERE interval_count >= {cfg.min_episode_intervals}),
"""


EPISODE = """src_ip, dst_port, start_ts, end_ts, duration_sec, interval_count, interval_sec, episode_type, max_syn_rate,
  max_pkt_rate, max_byte_rate, min_success_ratio, total_syn, total_packets, total_bytes, abuse_class"""
LISTED = "(ip_u32 IN (167772165, 167772169) OR (ip_u32 & 4294967280) = 167772224)"


def decided(raw: bool = False) -> str:
    c = t.CFG
    return totals(raw) + f"""
judged AS (SELECT *, {hits(c)} AS volumetric_hits, {LISTED} AS allowlisted,
  CASE WHEN {flood(c)} AND total_syn >= 10 THEN 'SYN_FLOOD_LIKE' WHEN {hits(c)} >= 2 THEN 'VOLUMETRIC_TCP_ABUSE'
       WHEN {flood(c)} THEN 'SYN_FLOOD_LIKE' END AS detected_class,
  CASE WHEN {flood(c)} AND total_syn < 10 THEN 'medium' ELSE 'high' END AS confidence FROM stats),
dec AS (SELECT * REPLACE (CASE WHEN NOT allowlisted THEN detected_class END AS detected_class),
  CASE WHEN NOT allowlisted THEN detected_class END AS abuse_class,
  CASE WHEN NOT allowlisted AND detected_class IS NOT NULL THEN 'block' ELSE 'allow' END AS decision,
  CASE WHEN NOT allowlisted AND detected_class IS NOT NULL THEN CAST({NOW + c.block_duration_sec} AS BIGINT) END AS until_ts
  FROM judged),
"""


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} * 100.0 ELSE 0.0::DOUBLE END"


def impact(minimum: int) -> str:
    blocked = lambda c: f"CAST(coalesce(sum(total_{c}) FILTER (decision = 'block'), 0) AS BIGINT) AS blocked_{c}"
    whole = lambda c: f"CAST(coalesce(sum(total_{c}), 0) AS BIGINT) AS total_{c}"
    three = ("packets", "bytes", "syn")
    return decided() + f"""
cf0 AS (SELECT count(*) AS n, {", ".join(whole(c) for c in three)}, {", ".join(blocked(c) for c in three)},
  CAST(coalesce(sum(total_packets) FILTER (decision = 'block' AND success_ratio >= {f(t.CFG.fp_safe_ratio)}), 0) AS BIGINT) AS fp_packets,
  count(*) FILTER (decision = 'block') AS blocked_keys FROM dec WHERE NOT allowlisted),
cf AS (SELECT *, {", ".join(f"{pct(f'blocked_{c}', f'total_{c}')} AS percent_{c}_blocked" for c in three)},
  n >= {minimum} AS fp_computed, CASE WHEN n >= {minimum} THEN {pct("fp_packets", "blocked_packets")} END AS fp_value_pct,
  CASE WHEN n < {minimum} THEN 'Insufficient data: ' || n || ' keys, need at least {minimum}' END AS fp_reason FROM cf0),
"""


TOP = """
top AS (SELECT * FROM dec WHERE decision = 'block' AND NOT allowlisted ORDER BY total_syn DESC, ip_u32, dst_port LIMIT 10),
"""


def rule_columns(cfg, value: str) -> str:
    return f"""'src_ip' AS key_type, {value} AS key_value, dst_port, coalesce(abuse_class, 'UNKNOWN') AS abuse_class,
  CAST({cfg.window_sec} AS BIGINT) AS window_sec, {f(cfg.syn_rate_threshold)} AS syn_rate_threshold,
  {f(cfg.success_ratio_threshold)} AS success_ratio_threshold, 'drop' AS action_type, CAST({cfg.block_duration_sec} AS BIGINT) AS duration_sec"""


FIRST_EP = """
first_ep AS (SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY src_ip, dst_port ORDER BY start_ts) = 1),
"""

MSG = """
msg AS (SELECT conv_id AS flow, turn, CASE role WHEN 'user' THEN 'to_server' ELSE 'from_server' END AS direction,
  CAST(length(text) AS BIGINT) AS body_len, conv_id * 60000000000 + turn * 1000000000 AS first_ts,
  conv_id * 60000000000 + turn * 1000000000 + length(text) * 1000 AS done_ts,
  CASE WHEN turn % 8 <> 1 THEN list_extract([200, 404, 500, 302], CAST(length(text) % 4 + 1 AS INTEGER)) END AS status,
  length(text) % 3 = 0 AS rpc_parsed,
  CASE WHEN length(text) % 6 = 0 THEN CAST(-32000 - length(text) % 7 AS INTEGER) END AS rpc_error_code
  FROM conversations WHERE role IN ('user', 'assistant')),
prior AS (SELECT *, lag(direction) OVER fl AS p_dir, lag(body_len) OVER fl AS p_len, lag(first_ts) OVER fl AS p_ts
  FROM msg WINDOW fl AS (PARTITION BY flow ORDER BY turn)),
pairs AS (SELECT flow, turn, p_len AS request_bytes, body_len AS response_bytes, status AS status_code,
  p_ts AS req_started_ns, done_ts AS resp_completed_ns, rpc_parsed AS rpc_envelope_parsed, rpc_error_code
  FROM prior WHERE direction = 'from_server' AND p_dir = 'to_server'),
"""
WIN = MSG + """
win AS (SELECT *, flow // 10 AS "window", CASE WHEN request_bytes > 0 THEN CAST(response_bytes AS DOUBLE) / request_bytes END AS ratio,
  CASE WHEN resp_completed_ns > req_started_ns THEN resp_completed_ns - req_started_ns END AS d FROM pairs),
"""
DIR = PK + """
dir AS (SELECT *, CASE WHEN dst_port IN (8000, 8001) THEN 'to_server' WHEN src_port IN (8000, 8001) THEN 'from_server' END AS way,
  src_ip * 65536 + src_port AS a, dst_ip * 65536 + dst_port AS b FROM pk),
"""

LOG = """
log0 AS (SELECT epoch_us(ts) // 1000000 AS ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id
  FROM events WHERE event_type = 'purchase'),
log AS (SELECT ts, seq, CASE WHEN k < 25 THEN 'stop' WHEN k < 50 THEN 'set-sample-rate' ELSE 'trigger' END AS action,
  CASE WHEN k % 10 = 9 THEN 'bad tag' ELSE 'inc-' || user_id END AS tag,
  CASE WHEN k < 25 THEN NULL WHEN k < 50 THEN k % 4 ELSE 1 + k % 5 END AS rate,
  CASE WHEN k >= 50 AND k % 3 > 0 THEN (k % 3) * 600 END AS duration_sec FROM log0),
cmd AS (SELECT * FROM log WHERE action = 'stop' OR (action = 'set-sample-rate' AND rate >= 1)
  OR (action = 'trigger' AND rate >= 1 AND regexp_full_match(tag, '[A-Za-z0-9_-]{1,64}'))),
"""
REG = LOG + f"""
state AS (SELECT ts AS start_ts, coalesce(lead(ts) OVER o, {2**62}) AS next_ts,
  coalesce(last_value(CASE WHEN action <> 'stop' THEN rate END IGNORE NULLS) OVER o, 1) AS rate,
  coalesce(last_value(CASE WHEN action <> 'set-sample-rate' THEN action = 'trigger' END IGNORE NULLS) OVER o, false) AS on_,
  last_value(CASE WHEN action = 'trigger' THEN {{'tag': tag, 'ts': ts, 'dur': duration_sec}} END IGNORE NULLS) OVER o AS tr
  FROM cmd WINDOW o AS (ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
until_ AS (SELECT *, CASE WHEN on_ THEN greatest(least(next_ts, coalesce(tr.ts + tr.dur, {2**62})), start_ts) ELSE start_ts END AS u FROM state),
reg AS (
  SELECT start_ts, u AS end_ts, true AS active, CAST(rate AS BIGINT) AS rate, tr.tag AS incident_tag, tr.ts AS trigger_ts FROM until_ WHERE start_ts < u
  UNION ALL
  SELECT u, next_ts, false, CAST(rate AS BIGINT), tr.tag, tr.ts FROM until_ WHERE u < next_ts),
"""
INREG = PK + REG + """
timed AS (SELECT event_id, cpu, ts_ns, ts_ns // 1000000000 AS ts FROM pk),
inreg AS (SELECT timed.*, reg.* FROM timed ASOF JOIN reg ON timed.ts >= reg.start_ts),
"""
SEEN = """seen AS (SELECT DISTINCT CASE WHEN direction = 'egress' THEN dst_ip ELSE src_ip END AS ip FROM pk)"""
HOST = """
hs0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
hs AS (SELECT user_id AS pid, epoch_us(ts) AS us, CASE WHEN k % 11 <> 0 THEN event_id * 7 % 100000 END AS cpu,
  CASE WHEN k % 13 <> 0 THEN CAST(round(value * 100) AS BIGINT) * 4096 END AS rss,
  CASE WHEN k % 17 <> 0 THEN CAST(k + 3 AS BIGINT) END AS fds, CASE WHEN k % 7 <> 0 THEN CAST(k * 2 AS BIGINT) END AS conns,
  CASE WHEN k % 5 <> 0 THEN event_id * 512 END AS io FROM hs0),
hl AS (SELECT *, lag(us) OVER p AS us0, lag(cpu) OVER p AS cpu0, lag(rss) OVER p AS rss0, lag(fds) OVER p AS fds0,
  lag(conns) OVER p AS conns0, lag(io) OVER p AS io0 FROM hs WINDOW p AS (PARTITION BY pid ORDER BY us)),
he AS (SELECT *, greatest(us - us0, 0) / 1e6 AS el FROM hl WHERE us0 IS NOT NULL),
"""
FRAME_HEX = """'0A00000000010A0000000002' || CASE WHEN ip_version = 4 THEN '0800' ELSE '86DD' END || '450000280000000040060000'"""
MARKED = PK + f"""
marked AS (SELECT src_port, dst_port, wire_len, CASE WHEN k % 10 = 3 THEN 2 WHEN direction = 'egress' THEN 1 ELSE 0 END AS direction,
  least(wire_len, 1200) AS cap_len, ts_ns // {DAY_NS} AS "window" FROM pk),
defects AS (SELECT *, CASE WHEN cap_len > 256 THEN 'cap_len over 256' WHEN cap_len > wire_len THEN 'cap_len over wire_len'
  WHEN direction NOT IN (0, 1) THEN 'unknown direction' END AS defect,
  CASE WHEN dst_port = 8000 THEN 1 WHEN src_port = 8000 THEN 2 END AS way FROM marked),
"""


def hashed(x: str) -> str:
    h = str(SEED)
    for shift in (24, 16, 8, 0):
        h = f"((xor({h}, ({x} >> {shift}) & 255) * 435) & {LOW_32})"
    return h


def q(ctes: str, select: str) -> str:
    return "WITH " + ctes.strip().rstrip(",") + "\n" + select


def digits(value: str, n: int) -> str:
    return f"format('{{:.{n}f}}', {value})"


def reason_sql(cfg) -> str:
    flood_text = (
        f"'syn_rate ' || {digits('max_syn_rate', 1)} || ' >= {cfg.syn_rate_threshold:.1f} AND success_ratio ' || "
        f"{digits('min_success_ratio', 4)} || ' <= {cfg.success_ratio_threshold:.4f}'"
    )
    part = lambda n, lim: f"CASE WHEN max_{n} >= {f(lim)} THEN '{n} ' || {digits('max_' + n, 1)} || ' >= {lim:.1f}' END"
    parts = ", ".join((part("syn_rate", cfg.vol_syn_rate), part("pkt_rate", cfg.vol_pkt_rate), part("byte_rate", cfg.vol_byte_rate)))
    n = hits(cfg, "max_syn_rate", "max_pkt_rate", "max_byte_rate")
    return (
        f"CASE abuse_class WHEN 'SYN_FLOOD_LIKE' THEN {flood_text} WHEN 'VOLUMETRIC_TCP_ABUSE' "
        f"THEN {n} || ' of 3 volumetric: ' || concat_ws(', ', {parts}) ELSE '' END"
    )


HTTP = f"""
http AS (SELECT {t.CLIENT_NET} + conv_id % 65536 AS client_ip, 20000 + conv_id // 65536 AS client_port, conv_id, turn, role, strlen(text) AS n,
  CASE WHEN role = 'assistant' THEN list_extract([200, 404, 500, 302], CAST(length(text) % 4 + 1 AS INTEGER)) END AS status,
  CASE role WHEN 'user' THEN 49 ELSE 47 END + strlen(CAST(strlen(text) AS VARCHAR)) AS head
  FROM conversations WHERE role IN ('user', 'assistant')),
hm AS (SELECT *, client_ip * 65536 + client_port AS flow_low, CASE role WHEN 'user' THEN 'to_server' ELSE 'from_server' END AS direction,
  {t.START_NS} + turn * 1000000000 AS first_ts, {t.START_NS} + turn * 1000000000 + (head + n - 1) // 700 * 1000 AS done_ts FROM http),
hp AS (SELECT *, lag(direction) OVER c AS p_dir, lag(n) OVER c AS p_n, lag(first_ts) OVER c AS p_ts FROM hm
  WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
"""
METER = f"""
m0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
m AS (SELECT epoch_us(ts) // 1000000 AS ts, event_id AS seq, {t.CLIENT_NET} + user_id AS ip_u32, event_id * 40 + k * 1000 AS syn,
  event_id AS ack, event_id * 2 + k * 10 AS handshake_ack, k AS rst, event_id * 50 + k AS packets, event_id * 4000 AS bytes FROM m0),
ml AS (SELECT *, lag(ts) OVER w IS NULL AS first, {", ".join(f"greatest({c} - lag({c}) OVER w, 0) AS d_{c}" for c in C6)}
  FROM m WINDOW w AS (PARTITION BY ip_u32 ORDER BY ts, seq)),
mi AS (SELECT ip_u32, ts, seq, {", ".join(f"d_{c} AS {c}" for c in C6)}, d_syn / 60.0::DOUBLE AS syn_rate,
  d_packets / 60.0::DOUBLE AS pkt_rate, d_bytes / 60.0::DOUBLE AS byte_rate,
  CASE WHEN d_syn > 0 THEN CAST(d_handshake_ack AS DOUBLE) / d_syn ELSE 0.0::DOUBLE END AS success_ratio FROM ml WHERE NOT first),
mh AS (SELECT *, {flood(METER_CFG)} OR {hits(METER_CFG)} >= 2 AS hot FROM mi),
mr AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY ip_u32 ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run,
  sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY ip_u32) AS colds FROM mh),
me AS (SELECT ip_u32, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS interval_count, max(syn_rate) AS max_syn_rate,
  max(pkt_rate) AS max_pkt_rate, max(byte_rate) AS max_byte_rate,
  coalesce(min(CASE WHEN syn > 0 THEN success_ratio END), 0.0::DOUBLE) AS min_success_ratio, CAST(sum(syn) AS BIGINT) AS total_syn,
  CAST(sum(packets) AS BIGINT) AS total_packets, CAST(sum(bytes) AS BIGINT) AS total_bytes
  FROM mr WHERE hot GROUP BY ip_u32, run),
"""
SIDE = lambda d: f"SELECT {KEYS}, {SUMS} FROM w WHERE direction = '{d}' GROUP BY ALL"
BUCKET = """{'key_type': 'src_ip', 'src_ip': %s, 'dst_port': dst_port, 'syn': syn, 'ack': ack, 'handshake_ack': handshake_ack,
  'rst': rst, 'packets': packets, 'bytes': bytes}""" % ip_text("ip_u32")
FAULT = """CASE WHEN k = 17 OR k = 7 THEN 'malformed JSON' WHEN k = 14 THEN 'missing field'
  WHEN k = 16 THEN 'value out of range' WHEN k IN (12, 13) THEN 'unsupported version'
  WHEN k = 10 THEN 'duplicate bucket field' WHEN k = 11 THEN 'unknown bucket field' WHEN k = 9 THEN 'missing bucket field'
  WHEN k = 1 THEN 'unknown key type' WHEN k IN (2, 3) THEN 'invalid IP address'
  WHEN k IN (4, 6, 8) THEN 'bucket value out of range' ELSE 'ok' END"""

ORACLE: dict[str, str] = {
    "q_packet_counters": q(W, SIDE("ingress")),
    "q_packet_counters_egress": q(W, SIDE("egress")),
    "q_packet_counters_both": q(W, f"SELECT {KEYS}, {SUMS} FROM w GROUP BY ALL"),
    "q_port_filter": q(W, "SELECT direction, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes FROM w WHERE port = 8000 GROUP BY 1"),
    "q_handshake_ack": q(
        PK, "SELECT direction, cpu, count(*) FILTER (ack AND NOT syn AND NOT rst AND payload_len = 0) AS handshake_acks,"
        " count(*) FILTER (ack) AS acks FROM pk GROUP BY 1, 2"
    ),
    "q_snap_length": q(
        PK, "SELECT CAST(least(wire_len, 256) AS INTEGER) AS cap_len, count(*) AS packets, count(*) * 38 AS captured"
        " FROM pk WHERE wire_len > 0 GROUP BY 1"
    ),
    "q_wall_clock": q(
        PK + "u AS (SELECT event_id, greatest(ts_ns + 5000000000 - 1704100000000000000, 0) AS n FROM pk)",
        "SELECT event_id, n // 1000000000 AS sec, n % 1000000000 // 1000 AS usec FROM u",
    ),
    "q_cumulative": q(CUM, "SELECT ts, ip_u32, dst_port, syn, ack, handshake_ack, rst, packets, bytes FROM cum"),
    "q_snapshot_assembly": q(
        CUM,
        f"""SELECT ts, '{{"version":7,"aggregation":"src_ip_dst_port","ts_unix_sec":' || ts || ',"interval_sec":{D},"run_id":7,'
        || '"counter_mode":"cumulative","base_ts_unix_sec":1704067200,"dst_ports":[8000,8001],"buckets":'
        || CAST(to_json(list({BUCKET} ORDER BY ip_u32, dst_port)) AS VARCHAR) || '}}' AS value FROM cum GROUP BY ts""",
    ),
    "q_heartbeats": q(
        CUM, "SELECT ts AS timestamp, row_number() OVER (ORDER BY ts) AS cycle, count(*) AS ips_collected,"
        " row_number() OVER (ORDER BY ts) AS snapshots_written FROM cum GROUP BY ts"
    ),
    "q_collection_result": q(
        CUM, "SELECT CAST(7 AS BIGINT) AS run_id, count(DISTINCT ts) AS cycles, count(*) AS total_ips,"
        " count(DISTINCT ts) AS snapshots_written FROM cum"
    ),
    "q_deltas": q(DELTA, "SELECT ts, ip_u32, dst_port, first, " + ", ".join(f"d_{c}" for c in C6) + " FROM delta"),
    "q_totals_raw": q(totals(True), f"SELECT {TOTALS} FROM stats"),
    "q_totals_baseline": q(totals(False), f"SELECT {TOTALS} FROM stats"),
    "q_totals_from_deltas": q(totals(False), f"SELECT {TOTALS} FROM stats"),
    "q_interval_stats": q(IV, "SELECT * FROM iv"),
    "q_hot_intervals": q(
        IV, f"SELECT ts, ip_u32, dst_port, syn_rate, success_ratio FROM iv WHERE {flood(t.EPISODE_CFG)} OR {hits(t.EPISODE_CFG)} >= 2"
    ),
    "q_episodes": q(episodes(t.EPISODE_CFG), f"SELECT {EPISODE} FROM ep"),
    "q_long_episodes": q(episodes(t.EPISODE_CFG.with_(min_episode_intervals=2)), f"SELECT {EPISODE} FROM ep"),
    "q_episode_reasons": q(episodes(PER_DAY), f"SELECT src_ip, dst_port, start_ts, {reason_sql(PER_DAY)} AS trigger_reason FROM ep"),
    "q_abuse_class": q(
        decided(), "SELECT ip_u32, dst_port, volumetric_hits, detected_class, confidence FROM judged"
    ),
    "q_decisions": q(decided(), "SELECT ip_u32, dst_port, allowlisted, abuse_class, confidence, decision, until_ts FROM dec"),
    "q_blocked_keys": q(decided(), "SELECT ip_u32, dst_port, total_syn, until_ts FROM dec WHERE decision = 'block' AND NOT allowlisted"),
    "q_non_allowlisted_keys": q(decided(), "SELECT ip_u32, dst_port, decision FROM dec WHERE NOT allowlisted"),
    "q_allowlist_join": q(
        PK + "k1 AS (SELECT CASE WHEN direction = 'egress' THEN dst_ip ELSE src_ip END AS ip_u32,"
        " CASE WHEN direction = 'egress' THEN src_port ELSE dst_port END AS dst_port, count(*) AS packets FROM pk GROUP BY 1, 2)",
        f"SELECT *, {LISTED} AS allowlisted FROM k1",
    ),
    "q_counterfactual": q(
        impact(t.CFG.min_samples_for_fp),
        "SELECT total_packets, total_bytes, total_syn, blocked_packets, blocked_bytes, blocked_syn,"
        " percent_packets_blocked, percent_bytes_blocked, percent_syn_blocked FROM cf",
    ),
    "q_fp_bound": q(impact(t.CFG.min_samples_for_fp), "SELECT fp_computed, fp_value_pct, fp_reason FROM cf"),
    "q_fp_bound_unknown": q(impact(10**9), "SELECT fp_computed, fp_value_pct, fp_reason FROM cf"),
    "q_top_offenders": q(
        decided() + TOP, "SELECT ip_u32, dst_port, abuse_class, syn_rate, success_ratio, total_packets AS would_block_packets,"
        " total_syn AS would_block_syn, total_bytes AS would_block_bytes FROM top"
    ),
    "q_analysed": q(decided(), "SELECT count(*) AS sources, count(*) FILTER (decision = 'block') AS would_be_blocked FROM dec"),
    "q_readiness": q(
        impact(t.CFG.min_samples_for_fp) + f"""
off AS (SELECT *, least(blocked_keys, {t.CFG.top_offenders}) AS offender_count FROM cf),
r AS (SELECT offender_count, concat_ws('|',
  CASE WHEN NOT fp_computed THEN 'False positive bound unknown: ' || fp_reason
       WHEN fp_value_pct > 5.0 THEN 'False positive bound too high: ' || {digits('fp_value_pct', 1)} || '%' END,
  CASE WHEN offender_count = 0 THEN 'No abuse pattern detected' END,
  CASE WHEN percent_syn_blocked < 1.0 AND offender_count > 0 THEN 'Minimal impact (<1% SYN blocked)' END,
  CASE WHEN total_packets = 0 THEN 'No traffic observed' END) AS reasons FROM off)""",
        "SELECT reasons, reasons = '' AS is_safe, offender_count FROM r",
    ),
    "q_evidence": q(
        decided(), f"SELECT {ip_text('ip_u32')} || ':' || dst_port AS source, coalesce(abuse_class, '') AS abuse_class,"
        f" {digits('syn_rate', 2)} AS syn_rate, {digits('success_ratio', 4)} AS success_ratio, decision,"
        " total_packets AS packets, total_bytes AS bytes, total_syn AS syn FROM dec"
    ),
    "q_rules": q(episodes(t.EPISODE_CFG) + FIRST_EP, f"SELECT {rule_columns(t.EPISODE_CFG, 'src_ip')} FROM first_ep WHERE NOT {LISTED}"),
    "q_rules_from_offenders": q(decided() + TOP, f"SELECT {rule_columns(t.CFG, ip_text('ip_u32'))} FROM top"),
    "q_exceptions": q(
        PK + SEEN,
        f"""SELECT DISTINCT 1 AS rank, ip & 4294967280 AS network, 28 AS prefix_len, 'src_cidr' AS key_type,
        {ip_text('(ip & 4294967280)')} || '/28' AS key_value FROM seen
        UNION ALL SELECT DISTINCT 0, ip, 32, 'src_ip', {ip_text('ip')} FROM seen WHERE ip % 7 = 0""",
    ),
    "q_offender_rates": q(
        decided() + TOP + episodes(t.CFG).replace(DELTA, "") + FIRST_EP,
        f"""SELECT {ip_text('top.ip_u32')} || ':' || top.dst_port AS source, coalesce(max_syn_rate, syn_rate) AS shown_syn_rate,
        coalesce(min_success_ratio, success_ratio) AS shown_success_ratio, top.total_packets AS would_block_packets,
        top.total_syn AS would_block_syn FROM top LEFT JOIN first_ep ON top.ip_u32 = first_ep.ip_u32 AND top.dst_port = first_ep.dst_port""",
    ),
    "q_single_window_gate": q(
        episodes(t.EPISODE_CFG), "SELECT bool_or(episode_type = 'single_window') AS has_single_window, count(*) AS episodes,"
        " count(abuse_class) AS triggers FROM ep"
    ),
    "q_run_header": q(
        CUM, f"""SELECT min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration_sec, CAST(7 AS BIGINT) AS version_min,
        CAST(7 AS BIGINT) AS version_max, CAST(7 AS BIGINT) AS run_id, CAST({D} AS BIGINT) AS interval_sec, '8000,8001' AS ports FROM cum"""
    ),
    "q_snapshot_roundtrip": q(CUM, "SELECT ts, 'src_ip' AS key_type, ip_u32, dst_port, syn, packets, bytes FROM cum"),
    "q_bad_lines": q(
        "e AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
        f"SELECT {FAULT} AS reason, count(*) AS lines FROM e WHERE k <> 18 GROUP BY 1",
    ),
    "q_bad_lines_located": q(
        """e AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, strftime(ts, '%Y%m%d00') AS hour,
        row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d00') ORDER BY event_id) AS line FROM events)""",
        f"""SELECT 'snapshot_' || hour || '.jsonl' AS file_name, line, {FAULT} AS reason FROM e WHERE k <> 18 AND {FAULT} <> 'ok'"""
    ),
    "q_time_slice": q(
        CUM, f"SELECT ts, count(*) AS keys, CAST(sum(packets) AS BIGINT) AS packets FROM cum"
        f" WHERE ts BETWEEN {1704067200 + 3 * D} AND {1704067200 + 9 * D} GROUP BY ts"
    ),
    "q_rpc_pairs": q(MSG, "SELECT * FROM pairs"),
    "q_window_features": q(
        WIN, """SELECT "window", count(*) AS count, CAST(sum(response_bytes) AS BIGINT) AS resp_bytes_total,
        max(request_bytes) AS req_bytes_max, max(response_bytes) AS resp_bytes_max,
        CAST(sum(request_bytes) AS DOUBLE) / count(*) AS req_bytes_mean, CAST(sum(response_bytes) AS DOUBLE) / count(*) AS resp_bytes_mean,
        round(avg(ratio), 9) AS amp_ratio_mean, max(ratio) AS amp_ratio_max, max(d) AS duration_ns_max,
        CAST(sum(d) AS BIGINT) // count(d) AS duration_ns_mean FROM win GROUP BY 1"""
    ),
    "q_amp_median": q(WIN, 'SELECT "window", median(ratio) AS amp_ratio_median FROM win WHERE ratio IS NOT NULL GROUP BY 1'),
    "q_status_fracs": q(
        WIN, 'SELECT "window", ' + ", ".join(
            f"count(*) FILTER (status_code BETWEEN {n}00 AND {n}99) / CAST(nullif(count(status_code), 0) AS DOUBLE) AS status_{n}xx_frac"
            for n in (2, 4, 5)
        ) + " FROM win GROUP BY 1"
    ),
    "q_rpc_errors": q(
        WIN, """SELECT "window", CASE WHEN bool_or(rpc_envelope_parsed) THEN least(count(DISTINCT rpc_error_code) FILTER (rpc_envelope_parsed), 5) END
        AS rpc_error_distinct_codes, CASE WHEN bool_or(rpc_envelope_parsed) THEN
        count(rpc_error_code) FILTER (rpc_envelope_parsed) / CAST(count(*) AS DOUBLE) END AS rpc_error_frac FROM win GROUP BY 1"""
    ),
    "q_port_cardinality": q(
        DIR, f"""SELECT ts_ns // {DAY_NS} AS "window", least(count(DISTINCT dst_port), 5) AS unique_dst_ports,
        least(count(DISTINCT src_port), 5) AS unique_src_ports FROM dir WHERE way IS NOT NULL GROUP BY 1"""
    ),
    "q_flow_key": q(
        DIR, "SELECT least(a, b) AS flow_low, greatest(a, b) AS flow_high, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes"
        " FROM dir WHERE way IS NOT NULL GROUP BY 1, 2"
    ),
    "q_direction": q(
        PK, "SELECT CASE WHEN dst_port IN (8000, 40001, 40002) THEN 'to_server' WHEN src_port IN (8000, 40001, 40002) THEN 'from_server'"
        " ELSE 'dropped' END AS direction, count(*) AS packets FROM pk GROUP BY 1"
    ),
    "q_idle_windows": q(
        PK + """h AS (SELECT ts_ns // 60000000000 AS minute, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes
        FROM pk GROUP BY 1), r AS (SELECT unnest(range(min(minute), max(minute) + 1)) AS minute FROM h)""",
        "SELECT r.minute, packets, bytes FROM r LEFT JOIN h ON r.minute = h.minute",
    ),
    "q_host_delta": q(
        HOST, """SELECT pid, us AS captured_us,
        round(CASE WHEN el >= 0.1 AND cpu - cpu0 IS NOT NULL THEN greatest(cpu - cpu0, 0) / 100.0::DOUBLE / el * 100.0 END, 6) AS cpu_mean, cpu_mean AS cpu_max,
        rss - rss0 AS rss_delta, CASE WHEN rss0 IS NOT NULL THEN rss END AS rss_max,
        round(CASE WHEN el >= 0.1 THEN (rss - rss0) / el END, 6) AS rss_slope_bps, fds - fds0 AS num_fds_delta,
        conns - conns0 AS num_connections_delta, CASE WHEN conns0 IS NOT NULL THEN conns END AS num_connections_max,
        io - io0 AS io_write_delta FROM he"""
    ),
    "q_scrub_drop": q(
        PK + """kept AS (SELECT direction, count(*) AS kept FROM pk WHERE NOT (src_ip < 2147483648 AND dst_ip < 2147483648) GROUP BY 1),
        internal AS (SELECT direction, count(*) AS internal FROM pk GROUP BY 1)""",
        "SELECT coalesce(kept.direction, internal.direction) AS direction, kept, internal FROM kept FULL JOIN internal ON kept.direction = internal.direction",
    ),
    "q_ip_hash": q(
        PK, f"SELECT {hashed('src_ip')} AS src_ip, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes FROM pk GROUP BY 1"
    ),
    "q_scrub_frames": q(
        PK, f"""SELECT event_id, {FRAME_HEX} || CASE WHEN ip_version = 4
        THEN printf('%08X%08X', {hashed('src_ip')}, {hashed('dst_ip')}) ELSE printf('%08X%08X', src_ip, dst_ip) END
        || printf('%04X%04X', src_port, dst_port) AS frame FROM pk"""
    ),
    "q_tag_hash": q(
        LOG, f"""SELECT tag, lower(lpad(to_hex(CAST(list_reduce(list_prepend(CAST({0xCBF29CE484222325} AS HUGEINT),
        list_transform(string_split(tag, ''), lambda x: CAST(ascii(x) AS HUGEINT))),
        lambda h, b: (xor(h, b) * {0x100000001B3}) % CAST({2**64} AS HUGEINT)) AS UBIGINT)), 16, '0')) AS tag_hash
        FROM (SELECT DISTINCT tag FROM cmd WHERE action = 'trigger')"""
    ),
    "q_sample_1_in_n": q(
        PK, "SELECT event_id, cpu FROM pk QUALIFY row_number() OVER (PARTITION BY cpu ORDER BY ts_ns, event_id) % 7 = 0"
    ),
    "q_regime": q(REG, "SELECT * FROM reg"),
    "q_packets_in_regime": q(INREG, "SELECT event_id, start_ts, active, rate, incident_tag, trigger_ts FROM inreg"),
    "q_sample_in_regime": q(
        INREG, "SELECT event_id, incident_tag, trigger_ts FROM inreg WHERE active"
        " QUALIFY row_number() OVER (PARTITION BY cpu, start_ts ORDER BY ts_ns, event_id) % rate = 0"
    ),
    "q_sample_with_carry": "WITH RECURSIVE " + INREG.strip() + """
act AS (SELECT *, row_number() OVER (PARTITION BY cpu, start_ts ORDER BY ts_ns, event_id) AS rn FROM inreg WHERE active),
per AS (SELECT cpu, start_ts, max(rate) AS rate, count(*) AS n, row_number() OVER (PARTITION BY cpu ORDER BY start_ts) AS i FROM act GROUP BY 1, 2),
fold AS (
  SELECT cpu, i, start_ts, rate, n, CAST(2 AS BIGINT) AS lft FROM per WHERE i = 1
  UNION ALL
  SELECT p.cpu, p.i, p.start_ts, p.rate, p.n,
    CASE WHEN f.n <= f.lft THEN f.lft - f.n ELSE f.rate - 1 - (f.n - f.lft - 1) % f.rate END
  FROM fold f JOIN per p ON p.cpu = f.cpu AND p.i = f.i + 1)
SELECT event_id, incident_tag, trigger_ts FROM act JOIN fold USING (cpu, start_ts)
WHERE rn - lft - 1 >= 0 AND (rn - lft - 1) % act.rate = 0""",
    "q_hour_partitions": q(
        "h AS (SELECT epoch_us(ts) // 3600000000 * 3600 AS hour_ts, count(*) AS packets FROM events GROUP BY 1)",
        "SELECT strftime(make_timestamp(hour_ts * 1000000), '%Y%m%d%H') AS hour, hour_ts, packets FROM h",
    ),
    "q_retention": q(
        f"""h AS (SELECT DISTINCT epoch_us(ts) // 3600000000 * 3600 AS hour_ts FROM events),
        a AS (SELECT hour_ts, greatest(1706600000 - hour_ts, 0) > {20 * D} AS old FROM h)""",
        """SELECT hour_ts, CASE WHEN old THEN 'removed_by_age' WHEN row_number() OVER (PARTITION BY old ORDER BY hour_ts DESC) <= 300
        THEN 'kept' ELSE 'removed_by_count' END AS verdict FROM a""",
    ),
    "q_run_dir_names": q(
        LOG, "SELECT seq, strftime(make_timestamp(ts * 1000000), '%Y%m%d-%H%M%SZ') AS run_dir, tag || '-' || ts AS incident_dir"
        " FROM cmd WHERE action = 'trigger'"
    ),
    "q_quality": q(
        MARKED, """SELECT "window", count(*) AS events, count(*) FILTER (defect IS NOT NULL) AS decode_errors,
        count(*) FILTER (defect IS NULL AND way IS NULL) AS events_filtered FROM defects GROUP BY 1"""
    ),
    "q_quality_totals": q(
        MARKED, """SELECT count(DISTINCT "window") AS windows_completed, count(*) AS total_events,
        count(*) FILTER (defect IS NOT NULL) AS total_decode_errors, count(*) FILTER (defect IS NULL AND way IS NULL) AS total_events_filtered FROM defects"""
    ),
    "q_quarantine": q(MARKED, "SELECT defect, count(*) AS events FROM defects WHERE defect IS NOT NULL GROUP BY 1"),
    "q_result_diff": q(
        W + f"both_ AS (SELECT {KEYS}, {SUMS} FROM w GROUP BY ALL), one AS ({SIDE('ingress')})",
        """SELECT *, 'expected' AS only_in, CAST(1 AS BIGINT) AS copies FROM (SELECT * FROM both_ EXCEPT ALL SELECT * FROM one)
        UNION ALL SELECT *, 'actual', 1 FROM (SELECT * FROM one EXCEPT ALL SELECT * FROM both_)""",
    ),
    "q_fixed_text": q(
        "e AS (SELECT event_id, value / 8 AS x FROM events)",
        f"SELECT event_id, {digits('x', 1)} AS d1, {digits('x', 2)} AS d2, {digits('x', 4)} AS d4 FROM e",
    ),
    "q_inferred_ports": q(CUM, "SELECT DISTINCT CAST(dst_port AS BIGINT) AS port FROM cum UNION SELECT unnest([8000, 9999])"),
    "q_framing": q(HTTP, "SELECT flow_low, direction, n AS body_len, status, first_ts, done_ts, false AS rpc_parsed FROM hm"),
    "q_framed_pairs": q(
        HTTP, "SELECT flow_low, p_n AS request_bytes, n AS response_bytes, status AS status_code, p_ts AS req_started_ns,"
        " done_ts AS resp_completed_ns FROM hp WHERE direction = 'from_server' AND p_dir = 'to_server'"
    ),
    "q_head_fields": q(
        HTTP, "SELECT CASE role WHEN 'user' THEN 0 ELSE 1 END AS direction, status, CAST(sum(head) AS BIGINT) AS head_bytes,"
        " CAST(sum(n) AS BIGINT) AS body_bytes FROM hm GROUP BY 1, 2"
    ),
    "q_payload_snapshots": q(
        WIN, """SELECT "window" * 60 + 60 AS ts_unix_sec, CAST(7 AS BIGINT) AS version, count(*) AS count,
        CAST(sum(response_bytes) AS BIGINT) AS resp_bytes_total, max(request_bytes) AS req_bytes_max, median(ratio) AS amp_ratio_median,
        max(ratio) AS amp_ratio_max, least(count(DISTINCT 30000 + flow % 7), 5) AS unique_src_ports,
        CAST(sum(d) AS BIGINT) // count(d) AS duration_ns_mean,
        count(*) FILTER (status_code BETWEEN 400 AND 499) / CAST(nullif(count(status_code), 0) AS DOUBLE) AS status_4xx_frac,
        CASE WHEN bool_or(rpc_envelope_parsed) THEN least(count(DISTINCT rpc_error_code) FILTER (rpc_envelope_parsed), 5) END
        AS rpc_error_distinct_codes FROM win GROUP BY "window\""""
    ),
    "q_report_evidence": q(
        decided() + f"""ev AS (SELECT {ip_text('ip_u32')} || ':' || dst_port || ',' || coalesce(abuse_class, '') || ',' || {digits('syn_rate', 2)} || ','
        || {digits('success_ratio', 4)} || ',' || decision || ',' || total_packets || ',' || total_bytes || ',' || total_syn AS value FROM dec)""",
        "SELECT value FROM ev UNION ALL SELECT 'source,abuse_class,syn_rate,success_ratio,decision,packets,bytes,syn'",
    ),
    "q_hourly_files": q(
        CUM, "SELECT ts, count(*) AS keys, CAST(sum(bytes) AS BIGINT) AS bytes, 'range' AS hours FROM cum"
        " WHERE strftime(make_timestamp(ts * 1000000), '%Y%m%d%H') BETWEEN '2024010500' AND '2024012023' GROUP BY ts"
        " UNION ALL SELECT ts, count(*), CAST(sum(bytes) AS BIGINT), 'all' FROM cum GROUP BY ts"
    ),
    "q_incident_files": q(
        PK, f"""SELECT 'cpu-' || cpu AS incident_tag, ts_ns // {DAY_NS} * {D} AS trigger_ts, count(*) AS packets, count(*) * 38 AS captured,
        true AS within FROM pk WHERE wire_len > 0 GROUP BY 1, 2"""
    ),
    "q_incident_segments": "WITH RECURSIVE " + PK.strip() + f"""
rec AS (SELECT 'cpu-' || cpu AS incident_tag, ts_ns // (30 * {DAY_NS}) * 30 * {D} AS trigger_ts, event_id, ts_ns,
  54 + (event_id * 7919 + wire_len) % 900 AS size FROM pk WHERE wire_len > 0),
num AS (SELECT *, row_number() OVER (PARTITION BY incident_tag, trigger_ts ORDER BY ts_ns, event_id) AS i FROM rec),
cuts AS (
  SELECT incident_tag, trigger_ts, i, size AS held, CAST(0 AS BIGINT) AS segment FROM num WHERE i = 1
  UNION ALL
  SELECT n.incident_tag, n.trigger_ts, n.i, CASE WHEN c.held >= 20000 THEN n.size ELSE c.held + n.size END,
    CASE WHEN c.held >= 20000 THEN c.segment + 1 ELSE c.segment END
  FROM cuts c JOIN num n ON n.incident_tag = c.incident_tag AND n.trigger_ts = c.trigger_ts AND n.i = c.i + 1)
SELECT incident_tag, trigger_ts, segment, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes,
  min(event_id) AS least_id, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns
FROM cuts JOIN num USING (incident_tag, trigger_ts, i) GROUP BY 1, 2, 3""",
    "q_archive": q(
        PK, f"""SELECT 'cpu-' || cpu AS incident_tag, ts_ns // {DAY_NS} * {D} AS trigger_ts, count(*) AS packets, count(*) * 38 AS captured
        FROM pk WHERE wire_len > 0 GROUP BY 1, 2"""
    ),
    "q_stream_counter_windows": q(
        W + f"x AS (SELECT {KEYS}, ts_ns // 3600000000000 * 3600 AS ts, {SUMS} FROM w GROUP BY ALL)", "SELECT * FROM x"
    ),
    "q_stream_deltas": q(
        METER, "SELECT ip_u32, first, count(*) AS rows, " + ", ".join(
            f"CAST(sum(CASE WHEN NOT first THEN d_{c} END) AS BIGINT) AS {c}" for c in ("syn", "ack", "rst", "packets", "bytes")
        ) + " FROM ml GROUP BY 1, 2"
    ),
    "q_stream_episodes": q(
        METER, f"""SELECT {ip_text('ip_u32')} AS src_ip, CAST(8000 AS INTEGER) AS dst_port, start_ts, end_ts, end_ts - start_ts + 60 AS duration_sec,
        interval_count, CAST(60 AS BIGINT) AS interval_sec, CASE WHEN interval_count = 1 THEN 'single_window' ELSE 'multi_window' END AS episode_type,
        max_syn_rate, max_pkt_rate, max_byte_rate, min_success_ratio, total_syn, total_packets, total_bytes,
        CASE WHEN {flood(METER_CFG, 'max_syn_rate', 'min_success_ratio')} THEN 'SYN_FLOOD_LIKE'
        WHEN {hits(METER_CFG, 'max_syn_rate', 'max_pkt_rate', 'max_byte_rate')} >= 2 THEN 'VOLUMETRIC_TCP_ABUSE' END AS abuse_class FROM me"""
    ),
    "q_stream_pairs": q(
        HTTP, "SELECT flow_low, p_n AS request_bytes, n AS response_bytes, status AS status_code, p_ts AS req_started_ns,"
        " done_ts AS resp_completed_ns FROM hp WHERE direction = 'from_server' AND p_dir = 'to_server'"
    ),
}
ORACLE["q_window_results"] = q(
    HTTP + """e AS (SELECT *, (head + n - 1) // 700 + 1 AS segments FROM hm), w AS (SELECT first_ts // 60000000000 AS minute,
    CAST(sum(segments) AS BIGINT) AS events, CAST(sum(CASE WHEN role = 'user' AND client_ip % 7 = 0 THEN segments ELSE 0 END) AS BIGINT) AS hidden,
    CAST(sum(segments // 2) AS BIGINT) AS odd FROM e GROUP BY 1),
    p AS (SELECT done_ts // 60000000000 AS minute, count(*) AS pairs FROM hp WHERE direction = 'from_server' AND p_dir = 'to_server' GROUP BY 1),""",
    """SELECT minute AS "window", events, CAST(0 AS BIGINT) AS decode_errors, CAST(0 AS BIGINT) AS events_filtered, hidden AS events_scrubbed,
    coalesce(pairs, 0) AS n_pairs, odd AS source_errors, coalesce(pairs, 0) > 0 AS has_aggregates FROM w LEFT JOIN p USING (minute)""",
)
ORACLE["q_rpc_envelopes"] = q(
    "r AS (SELECT length(text) AS l FROM conversations WHERE role = 'assistant' AND length(text) % 3 < 2)",
    "SELECT CASE WHEN l % 3 = 1 THEN CAST(-32600 - l % 7 AS INTEGER) END AS error_code, count(*) AS responses FROM r GROUP BY 1",
)
ORACLE["q_framing_rpc"] = q(
    """r AS (SELECT CASE role WHEN 'user' THEN 'to_server' ELSE 'from_server' END AS direction, length(text) AS l, strlen(text) AS n,
    role = 'assistant' AND l % 3 < 2 AS rpc_parsed, CASE WHEN role = 'assistant' AND l % 3 = 1 THEN CAST(-32600 - l % 7 AS INTEGER) END AS rpc_error_code
    FROM conversations WHERE role IN ('user', 'assistant')),""",
    "SELECT direction, rpc_parsed, rpc_error_code, count(*) AS messages, CAST(sum(CASE WHEN NOT rpc_parsed THEN n"
    " WHEN rpc_error_code IS NULL THEN 40 ELSE 41 END) AS BIGINT) AS body_bytes FROM r GROUP BY 1, 2, 3",
)
ORACLE["q_report_from_sink"] = ORACLE["q_report_evidence"]
ORACLE["q_snapshot_files"] = q(CUM, "SELECT DISTINCT ts // 3600 * 3600 AS hour_ts, CAST(1 AS BIGINT) AS seen FROM cum")
ORACLE["q_collection_result_parts"] = ORACLE["q_collection_result"]
ORACLE["q_heartbeats_parts"] = ORACLE["q_heartbeats"]
ORACLE["q_stream_idle_windows"] = ORACLE["q_idle_windows"]
ORACLE["q_stream_window_features"] = q(
    WIN, """SELECT resp_completed_ns // 10000000000 * 10 AS window_start, count(*) AS count, CAST(sum(response_bytes) AS BIGINT) AS resp_bytes_total,
    max(request_bytes) AS req_bytes_max, max(response_bytes) AS resp_bytes_max,
    CAST(sum(request_bytes) AS DOUBLE) / count(*) AS req_bytes_mean, CAST(sum(response_bytes) AS DOUBLE) / count(*) AS resp_bytes_mean,
    round(avg(ratio), 9) AS amp_ratio_mean, max(ratio) AS amp_ratio_max, median(ratio) AS amp_ratio_median, max(d) AS duration_ns_max,
    CAST(sum(d) AS BIGINT) // count(d) AS duration_ns_mean, """ + ", ".join(
        f"count(*) FILTER (status_code BETWEEN {n}00 AND {n}99) / CAST(nullif(count(status_code), 0) AS DOUBLE) AS status_{n}xx_frac" for n in (2, 4, 5)
    ) + """, CASE WHEN bool_or(rpc_envelope_parsed) THEN least(count(DISTINCT rpc_error_code) FILTER (rpc_envelope_parsed), 5) END AS rpc_error_distinct_codes,
    CASE WHEN bool_or(rpc_envelope_parsed) THEN count(rpc_error_code) FILTER (rpc_envelope_parsed) / CAST(count(*) AS DOUBLE) END AS rpc_error_frac,
    1 AS unique_dst_ports, least(count(DISTINCT flow % 1000), 5) AS unique_src_ports FROM win GROUP BY 1"""
)
ORACLE["q_stream_incident_files"] = ORACLE["q_archive"]
ORACLE["q_stream_quality"] = q(
    MARKED, """SELECT count(*) AS total_events, count(*) FILTER (defect IS NOT NULL) AS total_decode_errors,
    count(*) FILTER (defect IS NULL AND way IS NULL) AS total_events_filtered FROM defects"""
)


# -- documents, as one text that is cut into lines ------------------------------


def num(x: str) -> str:
    """A double of the documents: plain digits down to 1e-5."""
    text = f"CAST({x} AS VARCHAR)"
    return f"CASE WHEN {text} LIKE '%e-05' THEN '0.0000' || replace(replace({text}, 'e-05', ''), '.', '') ELSE {text} END"


def listed(name: str, value: str, source: str, order: str) -> str:
    """A JSON list of the objects ``value`` as an SQL expression."""
    return f"""(SELECT CASE WHEN count(*) = 0 THEN '  "{name}": []' ELSE '  "{name}": [\n' || string_agg({value}, ',\n' ORDER BY {order}) || '\n  ]' END FROM {source})"""


def cut(ctes: str, text: str) -> str:
    return q(ctes + f"doc AS (SELECT string_split({text}, chr(10)) AS l)", "SELECT unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS value FROM doc")


REPORTED = impact(t.CFG.min_samples_for_fp) + TOP + episodes(t.CFG).replace(DELTA, "") + FIRST_EP + f"""
span AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM cum),
whys AS (SELECT list_filter([
  CASE WHEN NOT fp_computed THEN 'False positive bound unknown: ' || fp_reason
       WHEN fp_value_pct > 5.0 THEN 'False positive bound too high: ' || {digits('fp_value_pct', 1)} || '%' END,
  CASE WHEN blocked_keys = 0 THEN 'No abuse pattern detected' END,
  CASE WHEN percent_syn_blocked < 1.0 AND blocked_keys > 0 THEN 'Minimal impact (<1% SYN blocked)' END,
  CASE WHEN total_packets = 0 THEN 'No traffic observed' END], lambda x: x IS NOT NULL) AS why FROM cf),
shown AS (SELECT {ip_text('top.ip_u32')} || ':' || top.dst_port AS source, top.*, coalesce(max_syn_rate, syn_rate) AS s, coalesce(min_success_ratio, success_ratio) AS r
  FROM top LEFT JOIN first_ep ON top.ip_u32 = first_ep.ip_u32 AND top.dst_port = first_ep.dst_port),
"""
RULES_TEXT = f"""'{{
  "version": 3,
  "generated_at": {NOW},
  "match_criteria": {{
    "proto": "tcp",
    "dst_ports": [
      8000,
      8001
    ]
  }},
' || """ + listed("triggers", f"""'    {{
      "key_type": "src_ip",
      "key_value": "' || src_ip || '",
      "dst_port": ' || dst_port || ',
      "abuse_class": "' || coalesce(abuse_class, 'UNKNOWN') || '",
      "window_sec": {t.CFG.window_sec},
      "syn_rate_threshold": ' || {num(f(t.CFG.syn_rate_threshold))} || ',
      "success_ratio_threshold": ' || {num(f(t.CFG.success_ratio_threshold))} || ',
      "action": {{
        "action_type": "drop",
        "duration_sec": {t.CFG.block_duration_sec}
      }}
    }}'""", f"first_ep WHERE NOT {LISTED}", "src_ip, dst_port") + """ || ',
  "exceptions": [
    {
      "key_type": "src_ip",
      "key_value": "10.0.0.5"
    },
    {
      "key_type": "src_ip",
      "key_value": "10.0.0.9"
    },
    {
      "key_type": "src_cidr",
      "key_value": "10.0.0.64/28"
    }
  ]
}'"""
ORACLE["q_rules_document"] = cut(REPORTED, RULES_TEXT)
ORACLE["q_report_document"] = cut(REPORTED, f"""'# Abuse Report

## 1. Scope & Configuration

- **Time window start**: ' || (SELECT t0 FROM span) || '
- **Time window end**: ' || (SELECT t1 FROM span) || '
- **Duration**: ' || (SELECT t1 - t0 FROM span) || ' seconds
- **Destination ports**: 8000, 8001
- **Window size**: {t.CFG.window_sec} seconds
- **SYN rate threshold**: ' || {digits(f(t.CFG.syn_rate_threshold), 1)} || ' SYN/sec
- **Success ratio threshold**: ' || {digits(f(t.CFG.success_ratio_threshold), 2)} || '
- **Block duration**: {t.CFG.block_duration_sec} seconds
- **Allowlist**: 2 IPs, 1 CIDRs

## 2. Abuse Pattern Observed

' || (SELECT CASE WHEN count(*) = 0 THEN 'No abuse pattern detected matching the trigger conditions.' ELSE
'Detected ' || count(*) || ' source(s) matching abuse pattern (TCP SYN churn).

### Top Offenders

| Source | SYN Rate | Success Ratio | Would Block Packets | Would Block SYN |
|--------|----------|---------------|---------------------|------------------|
' || string_agg('| ' || source || ' | ' || {digits('s', 1)} || '/sec | ' || {digits('r', 2)} || ' | ' || total_packets || ' | ' || total_syn || ' |', chr(10)
  ORDER BY total_syn DESC, ip_u32, dst_port) END FROM shown) || '

## 3. Counterfactual Enforcement Impact

### Blocked Traffic (if rules were enforced)

' || (SELECT '- **Packets blocked**: ' || {digits('percent_packets_blocked', 1)} || '%
- **Bytes blocked**: ' || {digits('percent_bytes_blocked', 1)} || '%
- **SYN blocked**: ' || {digits('percent_syn_blocked', 1)} || '%

### False Positive Bound

' || CASE WHEN NOT fp_computed THEN '- **FP bound**: UNKNOWN
- **Reason**: ' || fp_reason || '
- Enforcement decision should be made with caution.' ELSE '- **FP bound**: ' || {digits('fp_value_pct', 1)} || '%
' || CASE WHEN fp_value_pct = 0 THEN '- No likely legitimate traffic would be blocked.'
  WHEN fp_value_pct <= 5 THEN '- FP bound is within acceptable range (<= 5%).'
  ELSE '- **WARNING**: FP bound exceeds acceptable threshold (> 5%).' END END || '

### Uncertainty

' || CASE WHEN total_packets > 0 THEN '- Analysis based on ' || total_packets || ' total packets, ' || total_syn || ' total SYN.'
  ELSE '- No traffic was observed during the analysis window.' END FROM cf) || '

## 4. Candidate Enforcement Rules

```json
' || {RULES_TEXT} || '
```

## 5. Readiness Judgment

' || (SELECT CASE WHEN len(why) = 0 THEN '**This abuse class IS safe for autonomous enforcement.**

All safety criteria have been met:
- Abuse pattern clearly detected
- False positive bound within acceptable limits
- Meaningful impact on malicious traffic' ELSE '**This abuse class IS NOT safe for autonomous enforcement.**

Gating reasons:

' || array_to_string(list_transform(why, lambda x: '- ' || x), chr(10)) END FROM whys) || chr(10)""")
EPISODE_FIELDS = ",\n".join(f"""      "{n}": ' || {n} || '""" for n in ("start_ts", "end_ts", "duration_sec", "interval_count", "interval_sec"))
MAXIMA = ",\n".join(f"""      "{n}": ' || {num(n)} || '""" for n in ("max_syn_rate", "max_pkt_rate", "max_byte_rate"))
ORACLE["q_summary_document"] = cut(REPORTED + """
gate AS (SELECT CASE WHEN (SELECT bool_or(episode_type = 'single_window') FROM ep) THEN list_append(why, 'Single-window episode requires manual review') ELSE why END AS why FROM whys),
""", f"""'{{
  "report_version": 5,
  "run_id": 7,
  "input_schema_version_min": 7,
  "input_schema_version_max": 7,
  "time_range": {{
    "start_ts": ' || (SELECT t0 FROM span) || ',
    "end_ts": ' || (SELECT t1 FROM span) || ',
    "duration_sec": ' || (SELECT t1 - t0 FROM span) || '
  }},
  "ports_analyzed": [
    8000,
    8001
  ],
  "config": {{
    "window_sec": {t.CFG.window_sec},
    "syn_rate_threshold": ' || {num(f(t.CFG.syn_rate_threshold))} || ',
    "success_ratio_threshold": ' || {num(f(t.CFG.success_ratio_threshold))} || ',
    "block_duration_sec": {t.CFG.block_duration_sec},
    "vol_syn_rate": ' || {num(f(t.CFG.vol_syn_rate))} || ',
    "vol_pkt_rate": ' || {num(f(t.CFG.vol_pkt_rate))} || ',
    "vol_byte_rate": ' || {num(f(t.CFG.vol_byte_rate))} || '
  }},
' || """ + listed("triggers", f"""'    {{
      "abuse_class": "' || abuse_class || '",
      "src": "' || src_ip || '",
      "dst_port": ' || dst_port || ',
      "rates": {{
        "syn_rate": ' || {num('max_syn_rate')} || ',
        "pkt_rate": ' || {num('max_pkt_rate')} || ',
        "byte_rate": ' || {num('max_byte_rate')} || ',
        "success_ratio": ' || {num('min_success_ratio')} || '
      }},
      "confidence": "high"
    }}'""", "ep WHERE abuse_class IS NOT NULL", "abuse_class, src_ip, dst_port, start_ts") + " || ',\n' || " + listed("episodes", f"""'    {{
      "src_ip": "' || src_ip || '",
      "dst_port": ' || dst_port || ',
{EPISODE_FIELDS},
      "episode_type": "' || episode_type || '",
{MAXIMA},
      "abuse_class": "' || coalesce(abuse_class, '') || '",
      "trigger_reason": "' || {reason_sql(t.CFG)} || '"
    }}'""", "ep", "start_ts, src_ip, dst_port") + f""" || ',
' || (SELECT '  "blocked_traffic": {{
    "packets_blocked_pct": ' || {num('percent_packets_blocked')} || ',
    "bytes_blocked_pct": ' || {num('percent_bytes_blocked')} || ',
    "syn_blocked_pct": ' || {num('percent_syn_blocked')} || ',
    "packets_blocked_count": ' || blocked_packets || ',
    "bytes_blocked_count": ' || blocked_bytes || ',
    "syn_blocked_count": ' || blocked_syn || '
  }},
  "fp_bound": {{
    "computed": ' || fp_computed || ',
    "value_pct": ' || coalesce({num('fp_value_pct')}, 'null') || ',
    "reason": ' || coalesce('"' || fp_reason || '"', 'null') || '
  }},
' FROM cf) || (SELECT '  "enforcement_safe": ' || (len(why) = 0) || ',
  "enforcement_reasons": [' || CASE WHEN len(why) = 0 THEN '' ELSE chr(10) || array_to_string(list_transform(why, lambda x: '    "' || x || '"'), ',' || chr(10)) || chr(10) || '  ' END || ']
}}' FROM gate)""")


def evidence_lines_of(raw: bool) -> str:
    """The evidence document of one run, numbered."""
    return q(
        decided(raw) + f"""ev AS (SELECT 1 + row_number() OVER (ORDER BY ip_u32, dst_port) AS line_no, {ip_text('ip_u32')} || ':' || dst_port || ',' || coalesce(abuse_class, '')
        || ',' || {digits('syn_rate', 2)} || ',' || {digits('success_ratio', 4)} || ',' || decision || ',' || total_packets || ',' || total_bytes || ',' || total_syn AS value FROM dec)""",
        "SELECT line_no, value FROM ev UNION ALL SELECT 1, 'source,abuse_class,syn_rate,success_ratio,decision,packets,bytes,syn'",
    )


ORACLE["q_first_difference"] = f"""SELECT line_no, e.value AS expected, a.value AS actual
FROM ({evidence_lines_of(False)}) e FULL JOIN ({evidence_lines_of(True)}) a USING (line_no)
WHERE e.value IS DISTINCT FROM a.value ORDER BY line_no LIMIT 1"""
