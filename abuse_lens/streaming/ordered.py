"""State per key over rows in event-time order, whatever order they arrive in.

Rows wait in entries of a map state.  What a micro-batch brings for a key is cut in order of time into entries of at most
``ENTRY_ROWS`` rows, written once and never rewritten; one timer a key, at the end of the first slot of time that waits, fires
when the watermark has passed it.  Then all slots that it has passed are read, put in order, handed over and, entry by entry,
removed; what of an entry has been given out is told by the last slot's end.  So the state a batch writes grows with the batch,
not with what waits, and calls of the state store with keys and entries, not with rows or slots.  A row that is late, but within
the allowed lateness, changes nothing, and what is later still is dropped by Spark and counted in the query's progress
(``numRowsDroppedByWatermark``).  What a key carries from row to row is a typed value state, given up by a timer
when the key has been idle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Width of a slot: rows are given out at most so long after the watermark has passed them.
SLOT_MS = 60_000
#: Rows of an entry at most, and rows that a key takes in or hands over at a time.
ENTRY_ROWS = 256
HELD_ROWS = 16 * ENTRY_ROWS


def use_rocksdb(spark: SparkSession) -> None:
    """State variables and timers need this state store; the session's streams use it from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _InOrder(StatefulProcessor):
    def __init__(self, key, fields, kinds, order, time_ms, take, close, idle_ms, slot_ms, names, state):
        self.key, self.fields, self.kinds, self.order, self.time_ms = key, fields, kinds, order, time_ms
        self.take, self.close_key, self.idle_ms, self.slot_ms = take, close, idle_ms, slot_ms
        self.names, self.state = names, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "low bigint, high bigint, part bigint", f"rows array<struct<{self.kinds}>>")
        # entries so far, the slot up to which all is given out, the next timers of slots and of idleness
        self.head = handle.getValueState("head", "parts bigint, given bigint, due bigint, idle bigint")
        self.own = handle.getValueState("own", f"last bigint, {self.state}")

    def close(self) -> None:
        pass

    def slot(self, row: tuple) -> int:
        return self.time_ms(row) // self.slot_ms

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        part, given, due, idle = self.head.get() or (0, None, None, None)
        first = None
        arrived = (tuple(row[f] for f in self.fields) for row in rows)
        while held := sorted(islice(arrived, HELD_ROWS), key=self.time_ms):
            first = self.slot(held[0]) if first is None else min(first, self.slot(held[0]))
            for at in range(0, len(held), ENTRY_ROWS):
                entry = held[at : at + ENTRY_ROWS]
                self.parts.updateValue((self.slot(entry[0]), self.slot(entry[-1]), part), (entry,))
                part += 1
        if first is not None:
            end = (first + 1) * self.slot_ms
            if due is None or end < due:
                due = end
                self.handle.registerTimer(due)
            self.head.update((part, given, due, idle))
        return iter(())

    def _passed(self, given: int | None, border: int, left: list[int]) -> Iterator[list[tuple]]:
        """Waiting rows of the slots before ``border`` in order, many at a time; ``left`` gets the first slots of what still waits."""
        rows: list[tuple] = []
        for low, high, part in sorted(tuple(k) for k in self.parts.keys()):
            if low >= border:
                left.append(low)
                break
            if len(rows) >= HELD_ROWS:  # no entry from here on has rows before its first slot
                ready = [r for r in rows if self.slot(r) < low]
                if ready:
                    yield sorted(ready, key=lambda r: r[: self.order])
                rows = [r for r in rows if self.slot(r) >= low]
            entry = [tuple(r) for r in self.parts.getValue((low, high, part))[0]]
            if high < border:
                self.parts.removeKey((low, high, part))
            else:
                left.append(next(s for s in map(self.slot, entry) if s >= border))
            rows += [r for r in entry if (given is None or self.slot(r) >= given) and self.slot(r) < border]
        if rows:
            yield sorted(rows, key=lambda r: r[: self.order])

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self.head.get()
        if head is None:
            return
        key, passed = tuple(key), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        part, given, due, idle = head
        saved = self.own.get()
        last, own = (saved[0], tuple(saved[1:])) if saved else (None, None)
        row = lambda values: Row(**dict(zip(self.names, values, strict=True)))
        taken = False
        if due is not None and due <= passed:
            left: list[int] = []
            border = passed // self.slot_ms
            for rows in self._passed(given, border, left):
                own, out = self.take(key, own, rows)
                last, taken = self.time_ms(rows[-1]), True
                yield from map(row, out)
            given, due = border, (min(left) + 1) * self.slot_ms if left else None
            if due is not None:
                self.handle.registerTimer(due)
        if last is not None and due is None and last + self.idle_ms <= passed:
            yield from map(row, self.close_key(key, own))
            self.own.clear()
            self.head.clear()
            return
        if taken:
            self.own.update((last, *own))
        if last is not None and last + self.idle_ms > passed and (idle is None or idle <= passed):
            idle = last + self.idle_ms
            self.handle.registerTimer(idle)
        if (part, given, due, idle) != tuple(head):
            self.head.update((part, given, due, idle))


def in_order(
    timed: DataFrame,
    key: list[str],
    fields: list[str],
    order: int,
    time_ms: Callable[[tuple], int],
    take: Callable[[tuple, tuple | None, list[tuple]], tuple[tuple, list[tuple]]],
    close: Callable[[tuple, tuple], list[tuple]],
    idle_ms: int,
    schema: str,
    state: str,
    slot_ms: int = SLOT_MS,
) -> DataFrame:
    """Run ``take(key, own, rows) -> (own, output rows)`` over each key's rows, one or more whole slots at a time, in order.

    ``fields`` are the columns a row has; the first ``order`` of them are its place
    in the order, ``time_ms`` its event time, rounded down.  ``own`` is what the key keeps, with the columns of
    ``state`` (None at first).  ``close(key, own)`` gives the last output rows of a key that has been silent for ``idle_ms``
    behind the watermark and has no rows waiting.
    """
    use_rocksdb(timed.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in timed.schema.fields}
    kinds = ", ".join(f"{f}:{types[f]}" for f in fields)
    names = [f.split()[0] for f in schema.split(", ")]
    processor = _InOrder(key, fields, kinds, order, time_ms, take, close, idle_ms, slot_ms, names, state)
    return timed.groupBy(*key).transformWithState(processor, schema, "append", "eventTime")
