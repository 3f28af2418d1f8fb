import random

import pytest
from abuse_lens.functions.http import parse_envelope, parse_head
from abuse_lens.operators import framing, rpc, steps
from pyspark.sql import functions as F

EVENTS = (
    "src_ip bigint, dst_ip bigint, src_port int, dst_port int, tcp_seq bigint, ts_ns bigint, payload_len bigint, payload binary"
)
CLIENT, SERVER = 5, 9


@pytest.mark.parametrize(
    "data, response, expected",
    [
        (b"GET / HTTP/1.1\r\n\r\n", False, (18, 0, None)),
        (b"\r\nPOST /a HTTP/1.0\nContent-length: +7 \n\nxyz", False, (40, 7, None)),
        (b"HTTP/1.1 200\r\n\r\n", True, (16, 0, 200)),
        (b"HTTP/1.1 503 No\r\nContent-Length: x\r\nCONTENT-LENGTH: 3\r\n\r\n", True, (57, 3, 503)),
        (b"HTTP/1.1 200 OK\r\nContent-Length: " + b"9" * 23 + b"\r\ncontent-length: 4\r\n\r\n", True, (79, 4, 200)),
        (b"HTTP/1.1 200 OK\r\nContent-Length: " + b"9" * 23 + b"\r\n\r\n", True, (60, 0, 200)),
        (b"GET / HT", False, True),
        (b"GET / HTTP/1.1\r\nHost", False, True),
        (b"", False, True),
        (b"HTTP/1", True, True),
        (b"HTTP/2 200", True, False),
        (b"GET  / HTTP/1.1\r\n", False, False),
        (b"{\"a\": 1}", False, False),
        (b"\x16\x03\x01", False, False),
        (b"GET / HTTP/1.1\r\nbad header\r\n", False, False),
        (b"GET /" + b"a" * 17000, False, False),
        (b"GET / HTTP/1.1\r\n" + b"A: b\r\n" * 65, False, False),
        (b"GET / HTTP/1.1\r\n" + b"A: b\r\n" * 64 + b"\r\n", False, (402, 0, None)),
    ],
)
def test_parse_head(data, response, expected):
    assert parse_head(data, response) == expected


@pytest.mark.parametrize(
    "body, expected",
    [
        (b'{"jsonrpc":"2.0","result":1}', (True, None)),
        (b'{"jsonrpc":"","error":{"code":-32601,"message":"m"}}', (True, -32601)),
        (b'{"jsonrpc":"2.0","error":null}', (True, None)),
        (b'{"jsonrpc":"2.0","error":{}}', (True, None)),
        (b'{"jsonrpc":"2.0","error":{"code":2147483648}}', (False, None)),
        (b'{"jsonrpc":"2.0","error":{"code":1.5}}', (False, None)),
        (b'{"jsonrpc":"2.0","error":7}', (False, None)),
        (b'{"jsonrpc":2}', (False, None)),
        (b'{"id":1}', (False, None)),
        (b"oops", (False, None)),
        (b'{"jsonrpc":"2.0"} x', (False, None)),
        (b'{"jsonrpc":"2.0","result":{"a":1,"a":2}}', (True, None)),
        (b'{"jsonrpc":"2.0","jsonrpc":"2.0"}', (False, None)),
        (b'{"jsonrpc":"2.0","error":{"code":1,"code":2}}', (False, None)),
        (b'{"jsonrpc":"2.0","result":NaN}', (False, None)),
    ],
)
def test_parse_envelope(body, expected):
    assert parse_envelope(body) == expected


def http(response, body, status=200):
    head = f"HTTP/1.1 {status} OK\r\n" if response else "POST /r HTTP/1.1\r\n"
    return (head + f"Content-Length: {len(body)}\r\n\r\n").encode() + body


def events_of(rng, conn, script, sample_cap=1024):
    """Cut messages of a script [(is_response, bytes)] into events of random sizes."""
    rows, ts, seq = [], 0, 0
    for response, data in script:
        at = 0
        while at < len(data):
            n = rng.choice([1, 7, 40, 200, 1500, 4000])
            chunk = data[at : at + n]
            ts += rng.choice([1, 5, 400])
            ends = (SERVER, CLIENT + conn, 80, 1000) if response else (CLIENT + conn, SERVER, 1000, 80)
            rows.append((*ends, seq, ts, len(chunk), chunk[:sample_cap]))
            at, seq = at + n, seq + 1
    return rows


def one_chain_at_a_time(rows):
    """Brute force: from each message's first event, add one event after the other until it is over."""
    chains = {}
    for row in sorted(rows, key=lambda r: (r[5], r[4])):
        direction = "to_server" if row[3] == 80 else "from_server"
        flow = tuple(sorted((row[0] * 65536 + row[2], row[1] * 65536 + row[3])))
        chains.setdefault((*flow, direction), []).append(row)
    out = []
    for key, events in chains.items():
        first, response = 0, key[2] == "from_server"
        while first < len(events):
            for last in range(first, len(events)):
                taken = events[first : last + 1]
                heads = (parse_head(b"".join(e[7] for e in taken[:n]), response) for n in range(1, len(taken) + 1))
                n, head = next(((n, h) for n, h in enumerate(heads, 1) if h is not True), (0, True))
                if head is True:
                    continue
                if head is False:
                    break
                size, body_len, status = head
                if sum(e[6] for e in taken) >= size + body_len:
                    parts = [b"".join(e[7] for e in taken[:n])[size:], *[e[7] for e in taken[n:]]]
                    body, early = b"".join(parts), b"".join(parts[:-1])
                    whole = response and body and len(body) <= 8192 and (len(parts) == 1 or len(early) < 8192)
                    rpc_of = parse_envelope(body) if whole else (False, None)
                    out.append((*key, body_len, status, taken[0][5], taken[-1][5], taken[-1][4], *rpc_of))
                    break
            first = last + 1
    return sorted(out, key=repr)


def framed(spark, rows, width):
    events = rpc.directed(spark.createDataFrame(rows, EVENTS), [80])
    return sorted((tuple(r) for r in framing.frame_messages(events, width).collect()), key=repr)


def test_keep_alive_pairs_and_errors(spark):
    rng = random.Random(1)
    error = b'{"jsonrpc":"2.0","error":{"code":-7}}'
    script = [(False, http(False, b"a" * 10)), (True, http(True, error, 500)), (False, http(False, b"")), (True, http(True, b"ok"))]
    rows = events_of(rng, 0, script)
    events = rpc.directed(spark.createDataFrame(rows, EVENTS), [80])
    messages = framing.frame_messages(events, 300)
    pairs = rpc.pair_messages(messages, framing.FLOW, ["done_ts", "done_seq"], "done_ts", 200).orderBy("done_ts").collect()
    got = [(p.request_bytes, p.response_bytes, p.status_code, p.rpc_envelope_parsed, p.rpc_error_code) for p in pairs]
    assert got == [(10, len(error), 500, True, -7), (0, 2, 200, False, None)]


@pytest.mark.parametrize("width", [150, 400, 3000, 10**9])
def test_slices_frame_like_whole_connections(spark, width):
    rng = random.Random(width)
    rows = []
    for conn in range(5):
        script = []
        for _ in range(12 if conn else 60):  # the first connection is the long one
            body = bytes(rng.choice(b"{}ab\r\n \x00") for _ in range(rng.choice([0, 3, 900, 9000, 20000])))
            script.append((False, http(False, body[:500])))
            script.append((True, http(True, rng.choice([body, b'{"jsonrpc":"2.0"}']))))
            if rng.random() < 0.2:
                script.append((rng.random() < 0.5, b"\x16garbage" * rng.randrange(1, 300)))
        rows += events_of(rng, conn, script)
    expected = one_chain_at_a_time(rows)
    assert len(expected) > 40
    assert framed(spark, rows, width) == expected


def test_short_samples_count_true_lengths(spark):
    rows = [
        (SERVER, CLIENT, 80, 1000, 0, 1, 60000, http(True, b"x" * 150000)[:1024]),
        (SERVER, CLIENT, 80, 1000, 1, 2, 60000, b"x" * 1024),
        (SERVER, CLIENT, 80, 1000, 2, 3, 40000, b"x" * 1024),
    ]
    (m,) = framed(spark, rows, 10**9)
    assert (m[3], m[5], m[6], m[8]) == (150000, 1, 3, False)
    assert framed(spark, rows, 1) == [m]


def rounds_of(monkeypatch):
    """Counts the settled tables of the tree and of heads that go on."""
    rounds, plain = [], framing.settle
    for module in (framing, steps):
        monkeypatch.setattr(module, "settle", lambda df: rounds.append(df.columns) or plain(df))
    return rounds


def test_long_bodies_pass_through_many_slices(spark, monkeypatch):
    rounds = rounds_of(monkeypatch)
    rows = []
    for n, (direction, size) in enumerate([(0, 400000), (1, 500000), (0, 10), (1, 20)]):
        ends = (SERVER, CLIENT, 80, 1000) if direction else (CLIENT, SERVER, 1000, 80)
        data, ts = http(direction == 1, b"z" * size), n * 10**6
        for i in range(0, len(data), 2000):
            rows.append((*ends, i, ts + i, len(data[i : i + 2000]), data[i : i + 2000][:1024]))
    got = framed(spark, rows, 10000)  # about 40 slices per long message
    assert got == one_chain_at_a_time(rows) and len(got) == 4
    assert len(rounds) - 4 <= 12


def test_a_thousand_slices_that_depend_on_each_other(spark, monkeypatch):
    """Every head and every body crosses the end of its slice: the rounds grow with the logarithm only."""
    rounds = rounds_of(monkeypatch)
    rows = []
    for i in range(340):
        data = http(True, b'{"jsonrpc":"2.0","result":%d}' % i, 200 + i % 3)
        for a, b in ((0, 9), (9, 50), (50, len(data))):  # one event is one slice
            rows.append((SERVER, CLIENT, 80, 1000, len(rows), 10 * len(rows), len(data[a:b]), data[a:b]))
    got = framed(spark, rows, 10)
    assert len(rows) >= 1000 and got == one_chain_at_a_time(rows) and len(got) == 340
    assert len(rounds) - 4 <= 12  # four tables are written whatever depends on what


def test_heads_over_many_slices_and_events_without_bytes(spark):
    rng = random.Random(11)
    rows = []
    for n in range(30):
        response = n % 2 == 1
        ends = (SERVER, CLIENT, 80, 1000) if response else (CLIENT, SERVER, 1000, 80)
        data = http(response, b"b" * rng.choice([0, 5, 9000]), 200)
        cut = rng.choice([1, 3, 11])
        for a in range(0, min(len(data), 90), cut):
            if rng.random() < 0.1:
                rows.append((*ends, len(rows), len(rows) * 7, 0, b""))
            rows.append((*ends, len(rows), len(rows) * 7, len(data[a : a + cut]), data[a : a + cut]))
        if len(data) > 90:
            rows.append((*ends, len(rows), len(rows) * 7, len(data) - 90, data[90:500]))
    rows.append((SERVER, CLIENT, 80, 1000, len(rows), len(rows) * 7, 40, b"HTTP/1.1 200 OK\r\nContent-Length: 99999999999999999999"[:40]))
    want = one_chain_at_a_time(rows)
    assert len(want) > 10
    for width in (7, 50, 10**9):
        assert framed(spark, rows, width) == want


def test_step_functions_compose():
    rng = random.Random(12)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 5)):
            upto = sorted({0, *(rng.randint(0, 20) for _ in range(rng.randint(0, 4)))})
            parts.append(framing.merged(upto[-1], upto, [rng.choice([0, 0, 3, 17, 60]) for _ in upto]))
        whole = framing.compose(parts)
        for skip in range(120):
            at = skip
            for part in parts:
                at = part(at)
            assert whole(skip) == at


def test_no_events(spark):
    assert framed(spark, [], 10) == []
    only_other_ports = [(1, 2, 3, 4, 0, 0, 1, b"x")]
    assert spark.createDataFrame(only_other_ports, EVENTS).select(F.count("*")).first()[0] == 1
    assert framed(spark, only_other_ports, 10) == []
