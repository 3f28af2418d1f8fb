"""Request/response pairs of a stream of payload events, with state per connection.

Events that the watermark has passed are framed like a slice of the batch operator
(:mod:`abuse_lens.operators.framing`): what a direction keeps between two such slices is the bytes to skip and the open message, or
the events of a head that is not complete yet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from abuse_lens.operators.framing import FLOW, RESPONSE, envelope, few, walk
from abuse_lens.operators.rpc import directed
from abuse_lens.streaming.ordered import in_order
from abuse_lens.streaming.windows import event_time

PAIRS = (
    "flow_low bigint, flow_high bigint, request_bytes bigint, response_bytes bigint, status_code int, "
    "req_started_ns bigint, resp_completed_ns bigint, rpc_envelope_parsed boolean, rpc_error_code int"
)
_EVENTS = "array<struct<ts:bigint,seq:bigint,length:bigint,sample:binary>>"
_WAY = f"struct<skip:bigint,first_ts:bigint,body:bigint,status:int,parts:array<binary>,events:{_EVENTS}>"
STATE = f"requests {_WAY}, responses {_WAY}, asked_bytes bigint, asked_ts bigint"


def _frame(way, events: list[tuple], response: bool):
    """Messages (first_ts, ts, seq, body, status, body parts) of a direction, and what it keeps."""
    skip, first_ts, body, status, parts, waiting = way or (0, None, None, None, [], [])
    events = [tuple(e) for e in waiting or ()] + events
    samples = [bytes(e[3] or b"") for e in events]
    ends = np.cumsum([max(e[2] or 0, len(s)) for e, s in zip(events, samples, strict=True)])
    closes, messages, opens = walk(ends, samples, skip, response)
    out = []
    if skip:
        parts = [bytes(p) for p in parts or ()]
        upto = len(events) if closes is None else closes + 1
        parts += samples[:upto] if response else []
        if closes is None:
            return [], (skip - int(ends[-1]) if len(ends) else skip, first_ts, body, status, few(parts), [])
        out.append((first_ts, events[closes][0], events[closes][1], body, status, parts))
    for i, last, head, found in messages:
        out.append((events[i][0], events[last][0], events[last][1], head.body, head.status, found))
    if opens is None:
        return out, None
    i, rest = opens
    if rest is None:
        return out, (0, None, None, None, [], events[i:])
    head, goal, found = rest
    # no message of 2^62 bytes ever ends
    return out, (goal - int(ends[-1]), events[i][0], min(head.body, 1 << 62), head.status, few(found), [])


def stream_pairs(
    events: DataFrame, server_ports, lateness: str = "10 seconds", idle_sec: int = 300
) -> DataFrame:
    """Pairs as their responses complete; a connection idle for ``idle_sec`` is forgotten.

    Events of one connection are taken in time order once the watermark has passed them.
    """

    def take(key, own, rows):
        kept = dict(zip(("to_server", RESPONSE), own[:2] if own else (None, None), strict=True))
        asked = tuple(own[2:]) if own else (None, None)
        done = []
        for way in kept:
            mine = [(ts, seq, length, sample) for ts, seq, direction, length, sample in rows if direction == way]
            found, kept[way] = _frame(kept[way], mine, way == RESPONSE)
            done += [(ts, seq, way, first_ts, body, status, parts) for first_ts, ts, seq, body, status, parts in found]
        out = []
        for ts, _, way, first_ts, body, status, parts in sorted(done, key=lambda d: d[:2]):
            if way == RESPONSE and asked[1] is not None:
                out.append((*key, asked[0], body, status, asked[1], ts, *envelope(parts)))
            asked = (None, None) if way == RESPONSE else (body, first_ts)
        return (kept["to_server"], kept[RESPONSE], *asked), out

    timed = event_time(directed(events.drop("direction"), server_ports), "ts_ns", lateness)
    return in_order(
        timed, FLOW, ["ts_ns", "tcp_seq", "direction", "payload_len", "payload"], 2, lambda row: row[0] // 1_000_000,
        take, lambda key, own: [], idle_sec * 1000, PAIRS, STATE,
    )
