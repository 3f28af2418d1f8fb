"""Request and response messages out of payload events, by composition over slices of time.

Where a message of a connection ends decides where the next begins.  With running sums of
segment lengths this is arithmetic: a head that begins with an event tells at which sum its message is
over, and the next begins with the event behind that.  All a slice can inherit is a
number of bytes to skip before its first message begins (0: at once), and all it hands on is such a number.  So a slice is a
step function from bytes to skip to bytes to skip, which is tabulated without knowing what comes before it.

Step functions of neighbouring slices compose.  They are composed in a tree whose nodes join up to ``FANOUT``
slices (``operators/steps.py``), then the numbers are handed down the tree, so the rounds grow with the logarithm of a
chain, whatever its slices depend on.  A head that goes on behind its slice's end is finished with the bytes that
follow it, at most ``MAX_HEAD_BYTES``, which are collected by doubling.  At last every slice is walked once, from the event it is
known to begin with; a message over several slices is put together from what they say of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abuse_lens.functions.http import BODY_KEEP_BYTES, MAX_BUFFER_BYTES, MAX_HEAD_BYTES, parse_envelope, parse_head
from abuse_lens.operators.slices import in_runs, running_in_slices, with_slice
from abuse_lens.operators.steps import SLICE, Steps, compose, entries, merged, names_of, table_of
from abuse_lens.plans.settle import settle

FLOW = ["flow_low", "flow_high"]
CHAIN = [*FLOW, "direction"]
CUT = [*CHAIN, SLICE]
#: Events in order; what is equal in all of it is interchangeable.
ORDER = ["ts_ns", "tcp_seq", "payload_len", "payload"]
RESPONSE = "from_server"
#: A head that the chain's end leaves open is never followed by a message.
NEVER = 1 << 62
_KEY = "flow_low bigint, flow_high bigint, direction string"
MESSAGES = (
    f"{_KEY}, body_len bigint, status int, first_ts bigint, done_ts bigint, done_seq bigint, "
    "rpc_parsed boolean, rpc_error_code int"
)
_STEPS = table_of(_KEY)
_OPEN = "starts array<int>, offsets array<int>, before array<bigint>, tail binary"
_HEADS = "starts array<int>, at array<bigint>, sizes array<int>, bodies array<string>, codes array<int>, rests array<binary>"
#: What a slice says: its messages, and its share of those that cross its ends.
_SAID = (
    f"{MESSAGES}, {SLICE} bigint, kind int, body_text string, head_until bigint, length bigint, ends array<bigint>, samples array<binary>"
)


class Head(NamedTuple):
    """A complete head: where it ends in the bytes joined so far, its body's length, its status."""

    size: int
    body: int
    status: int | None


def find_head(samples: Sequence[bytes], first: int, response: bool, data: bytes = b"") -> tuple[int, Head | None, bytes] | None:
    """The event that decides on the head beginning with ``first``, the head (None: it is none) and the bytes joined.

    ``data`` are bytes that precede.  None if the samples end before that.
    """
    for j in range(first, len(samples)):
        if j > first and not samples[j]:
            continue
        if len(data) + len(samples[j]) > MAX_BUFFER_BYTES:
            return j, None, b""
        data += samples[j]
        parsed = parse_head(data, response)
        if parsed is not True:
            return j, Head(*parsed) if parsed else None, data
    return None


class Walk(NamedTuple):
    """What the events of a slice hold, given the bytes to skip at first.

    ``closes``: the event that ends what was open before; ``messages``: (first, last, head, body parts);
    ``opens``: the event that begins what stays open, and if its head is complete (head, sum it ends at, body parts).
    """

    closes: int | None
    messages: list[tuple[int, int, Head, list[bytes]]]
    opens: tuple[int, tuple[Head, int, list[bytes]] | None] | None


def walk(ends: np.ndarray, samples: Sequence[bytes], skip: int, response: bool) -> Walk:
    closes, i, messages = None, 0, []
    if skip:
        closes = int(np.searchsorted(ends, skip))
        if closes == len(ends):
            return Walk(None, [], None)
        i = closes + 1
    while i < len(ends):
        found = find_head(samples, i, response)
        if found is None:
            return Walk(closes, messages, (i, None))
        j, head, data = found
        if head is None:
            i = j + 1
            continue
        goal = _goal(ends, i, j, head)
        last = int(np.searchsorted(ends, goal))
        parts = [data[head.size :], *samples[j + 1 : last + 1]] if response else []
        if last == len(ends):
            return Walk(closes, messages, (i, (head, goal, parts)))
        messages.append((i, last, head, parts))
        i = last + 1
    return Walk(closes, messages, None)


def _goal(ends: np.ndarray, first: int, decided: int, head: Head) -> int:
    """The running sum at which the message is over: true segment lengths count, not samples."""
    begin = int(ends[first - 1]) if first else 0
    return min(max(int(ends[decided]), begin + head.size + head.body), NEVER)


def few(parts: Sequence[bytes]) -> list[bytes]:
    """As many parts as tell whether a body outgrows what is kept."""
    sizes = np.cumsum([len(p) for p in parts])
    return list(parts[: int(np.searchsorted(sizes, BODY_KEEP_BYTES, side="right")) + 1])


def envelope(parts: Sequence[bytes]) -> tuple[bool, int | None]:
    """JSON-RPC of a body kept whole: one that outgrew what is kept, or filled it before its last event, is not read."""
    size = sum(map(len, parts))
    full_early = len(parts) > 1 and size - len(parts[-1]) >= BODY_KEEP_BYTES
    return (False, None) if not size or size > BODY_KEEP_BYTES or full_early else parse_envelope(b"".join(parts))


def tabulate(ends: np.ndarray, samples: Sequence[bytes], response: bool) -> tuple[list[int], list[int]]:
    """Bytes to skip behind the slice if a message begins with event m, for m = 0 ... n; and the events whose head stays open (-m - 1 there)."""
    n = len(ends)
    skips, unfinished = [0] * (n + 1), []
    for m in range(n - 1, -1, -1):
        found = find_head(samples, m, response)
        if found is None:
            skips[m] = -m - 1
            unfinished.append(m)
            continue
        j, head, _ = found
        goal = int(ends[j]) if head is None else _goal(ends, m, j, head)
        skips[m] = goal - int(ends[-1]) if goal > ends[-1] else skips[int(np.searchsorted(ends, goal)) + 1]
    return skips, unfinished[::-1]


def _tabulated(key: tuple, events: dict[str, list]) -> Iterator[tuple]:
    ends, samples = np.cumsum(events["payload_len"]), events["payload"]
    skips, unfinished = tabulate(ends, samples, key[2] == RESPONSE)
    reached = [0, *(m + 1 for m in range(len(ends)) if ends[m] > (ends[m - 1] if m else 0))]
    steps = merged(int(ends[-1]), [int(ends[m - 1]) if m else 0 for m in reached], [skips[m] for m in reached])
    tail = b"".join(samples[unfinished[0] :]) if unfinished else b""
    sizes = np.concatenate([[0], np.cumsum([len(s) for s in samples])])
    offsets = [int(sizes[m] - sizes[unfinished[0]]) for m in unfinished]
    before = [int(ends[-1] - (ends[m - 1] if m else 0)) for m in unfinished]
    yield (*key, steps.total, int(sizes[-1]), steps.upto, steps.skips, unfinished, offsets, before, tail)


# --- heads behind the end of their slice ---


_LEADING = f"{_KEY}, {SLICE} bigint, total bigint, ends array<bigint>, samples array<binary>"


def _leading(key: tuple, events: dict[str, list]) -> Iterator[tuple]:
    """The first events of a slice, as far as any head can reach."""
    ends, samples = np.cumsum(events["payload_len"]), events["payload"]
    full = [i for i in range(len(samples)) if samples[i]]
    sizes = np.cumsum([len(samples[i]) for i in full])
    full = full[: int(np.searchsorted(sizes, MAX_HEAD_BYTES, side="right")) + 1]
    yield (*key, int(ends[-1]), [int(ends[i]) for i in full], [samples[i] for i in full])


def _finish(sliced: DataFrame, opened: DataFrame, after: DataFrame) -> DataFrame:
    """``opened`` with its open heads finished; what follows a slice is looked at twice as far each time, until that is enough."""
    c = F.col
    chains = opened.select(*CHAIN).distinct()
    lead = settle(in_runs(sliced.join(chains, CHAIN, "left_semi"), CUT, ORDER, _leading, _LEADING).join(after, CUT))
    behind = opened.join(after, CUT)
    held = F.aggregate("samples", F.lit(0), lambda n, s: n + F.octet_length(s))
    more = (held <= MAX_HEAD_BYTES) & c("next").isNotNull()
    while True:
        given = lead.select(*CHAIN, c(SLICE).alias("next"), "ends", "samples", more.alias("more"))
        heads = settle(behind.join(given, [*CHAIN, "next"], "left").drop("next").mapInPandas(_finished, f"{_STEPS}, {_HEADS}, more boolean"))
        if heads.where(c("more") & F.array_contains("at", NEVER)).isEmpty():
            return heads.drop("more")
        then = lead.select(*CHAIN, c(SLICE).alias("next"), *[c(n).alias(f"_{n}") for n in ("total", "ends", "samples")], c("next").alias("_after"))
        joined = lead.join(then, [*CHAIN, "next"], "left").withColumn("_shift", c("total"))
        shifted = F.transform("_ends", lambda e: e + c("_shift"))
        lead = settle(
            joined.select(
                *CUT,
                F.when(more, c("total") + c("_total")).otherwise(c("total")).alias("total"),
                F.when(more, F.concat("ends", shifted)).otherwise(c("ends")).alias("ends"),
                F.when(more, F.concat("samples", "_samples")).otherwise(c("samples")).alias("samples"),
                F.when(more, c("_after")).otherwise(c("next")).alias("next"),
            )
        )


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Finish open heads with the events that follow: ``at`` is the byte behind the slice at which the message (or no head) is over."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            ends, samples = (list(x) if x is not None else [] for x in (row.ends, row.samples))
            heads = []
            for offset, before in zip(row.offsets, row.before, strict=True):
                found = find_head(samples, 0, row.direction == RESPONSE, bytes(row.tail[offset:]))
                if found is None:
                    heads.append((NEVER, 0, "0", -1, b""))
                    continue
                j, head, data = found
                if head is None:
                    heads.append((int(ends[j]), 0, "0", -1, b""))
                    continue
                at = max(int(ends[j]), head.size + head.body - before)
                heads.append((min(at, NEVER), int(ends[j]), str(head.body), -1 if head.status is None else head.status, data[head.size :]))
            swap = {-m - 1: h[0] for m, h in zip(row.starts, heads, strict=True)}
            skips = [swap.get(s, s) for s in row.skips]
            key = tuple(getattr(row, k) for k in CUT)
            out.append((*key, row.total, row.sampled, list(row.upto), skips, list(row.starts), *map(list, zip(*heads, strict=True)), row.more is True))
        yield pd.DataFrame(out, columns=names_of(f"{_STEPS}, {_HEADS}, more boolean"))


# --- messages ---


def _said(key: tuple, rows: dict[str, list]) -> Iterator[tuple]:
    """``rows``: what is known of the slice, if anything (``event`` 0), then its events."""
    chain, at, response = key[:3], key[3], key[2] == RESPONSE
    known = not rows["event"][0]
    ts, seq, lengths, samples = (rows[n][known:] for n in ("ts_ns", "tcp_seq", "payload_len", "payload"))
    skip, seen = rows["skip"][0], rows["seen"][0]
    ends = np.cumsum(lengths)
    closes, messages, opens = walk(ends, samples, skip, response)
    for i, last, head, parts in messages:
        parsed, code = envelope(parts)
        yield (*chain, head.body, head.status, ts[i], ts[last], seq[last], parsed, code, at, 0, None, 0, 0, [], [])
    if skip:
        # a share of the message that was open before; samples far behind its head are not looked at
        last = len(ends) - 1 if closes is None else closes
        wanted = response and seen <= MAX_HEAD_BYTES + BODY_KEEP_BYTES
        size = np.cumsum([len(s) for s in samples[: last + 1]])
        near = int(np.searchsorted(size, MAX_HEAD_BYTES + BODY_KEEP_BYTES, side="right")) + 1 if wanted else 0
        shares = list(range(min(near, last + 1)))
        if wanted and closes is not None and last not in shares:
            shares.append(last)
        end = (None, None) if closes is None else (ts[closes], seq[closes])
        if wanted or closes is not None:
            yield (*chain, None, None, None, *end, None, None, at, 1, None, 0, int(ends[-1]), [int(ends[i]) for i in shares], [samples[i] for i in shares])
    if opens is not None and known:
        i, rest = opens
        status, body, until, parts = None, None, 0, []
        starts = [] if rows["starts"][0] is None else list(rows["starts"][0])
        if rest is not None:
            head, _, parts = rest
            status, body, parts = head.status, str(head.body), few(parts)
        elif i in starts:
            k = starts.index(i)
            until = int(rows["sizes"][0][k])
            if until:  # else no head after all
                body, status, parts = rows["bodies"][0][k], int(rows["codes"][0][k]), [bytes(rows["rests"][0][k])]
                status = None if status < 0 else status
        yield (*chain, None, status, ts[i], None, None, None, None, at, 2, body, until, int(ends[-1]), [0] * len(parts), parts)


def _put_together(key: tuple, shares: dict[str, list]) -> Iterator[tuple]:
    """The message that one slice opens and a later one closes, if both are there."""
    if shares["kind"][0] != 2 or not shares["closed"][-1] or shares["body_text"][0] is None:
        return
    parts, base = [bytes(s) for s in shares["samples"][0]], 0
    for ends, samples, length in list(zip(shares["ends"], shares["samples"], shares["length"], strict=True))[1:]:
        parts += [bytes(s) for e, s in zip(ends, samples, strict=True) if base + e > shares["head_until"][0]]
        base += length
    parsed, code = envelope(parts) if key[2] == RESPONSE else (False, None)
    first, last = shares["first_ts"][0], shares["done_ts"][-1]
    yield (*key[:3], int(shares["body_text"][0]), shares["code"][0], first, last, shares["done_seq"][-1], parsed, code)


def frame_messages(events: DataFrame, slice_ns: int = 60_000_000_000) -> DataFrame:
    """Completed messages of directed payload events (see ``rpc.directed``).

    A segment is at least as long as what was captured of it.  Slices of ``slice_ns`` are framed in parallel; the
    width changes no message.
    """
    c = F.col
    captured = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint")
    known = events.select(
        *[F.coalesce(k, F.lit(-1).cast("bigint")).alias(k) for k in FLOW], "direction", "ts_ns", "tcp_seq",
        F.greatest(F.coalesce(c("payload_len").cast("bigint"), F.lit(0).cast("bigint")), captured).alias("payload_len"),
        F.coalesce("payload", F.unhex(F.lit(""))).alias("payload"),
    )
    sliced, at = with_slice(known, "ts_ns", slice_ns)
    sliced = settle(sliced.withColumnRenamed(at, SLICE))  # every step reads it
    by_chain = Window.partitionBy(*CHAIN).orderBy(SLICE)
    after = sliced.select(*CUT).distinct().withColumn("next", F.lead(SLICE).over(by_chain))
    after = after.withColumn("alone", c("next").isNull() & F.lag(SLICE).over(by_chain).isNull())
    after = settle(after.where(~c("alone")).drop("alone"))  # a slice that is all of its chain has nothing to hand on

    tables = settle(in_runs(sliced.join(after.select(*CUT), CUT, "left_semi"), CUT, ORDER, _tabulated, f"{_STEPS}, {_OPEN}"))
    opened = tables.where(F.size("starts") > 0)
    steps_columns = names_of(_STEPS)
    closed = tables.where(F.size("starts") == 0).select(*steps_columns)
    nothing = [F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in _HEADS.split(", ")]
    heads = None
    if not opened.isEmpty():
        heads = _finish(sliced, opened, after)
    steps = closed if heads is None else closed.unionByName(heads.select(*steps_columns))
    given = entries(steps, _KEY)
    given = given.select("*", *nothing) if heads is None else given.join(heads.drop("total", "sampled", "upto", "skips"), CUT, "left")

    zero = F.lit(0).cast("bigint")
    rows = sliced.select(*CUT, F.lit(1).alias("event"), *ORDER, zero.alias("skip"), zero.alias("seen"), *nothing)
    no_event = [F.lit(None).cast(sliced.schema[n].dataType).alias(n) for n in ORDER]
    ahead = given.select(*CUT, F.lit(0).alias("event"), *no_event, "skip", "seen", *names_of(_HEADS))
    said = settle(in_runs(rows.unionByName(ahead), CUT, ["event", *ORDER], _said, _SAID))
    names = names_of(MESSAGES)
    crossing = said.where("kind > 0").withColumn("opened", F.when(c("kind") == 2, c(SLICE)))
    hour, wide = with_slice(crossing, SLICE, 1024)
    placed = running_in_slices(hour, CHAIN, [SLICE, "kind"], wide, {"message": ("max", c("opened"))}).drop(wide, "opened")
    shares = placed.where(c("message").isNotNull()).withColumn("closed", c("done_ts").isNotNull()).withColumnRenamed("status", "code")
    whole = in_runs(shares, [*CHAIN, "message"], [SLICE], _put_together, MESSAGES)
    return said.where("kind = 0").select(*names).unionByName(whole)
