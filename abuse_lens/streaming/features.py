"""Complete window features of a stream, and a row for every empty window.

What a feature needs of a window is counted exactly: state value -> count, for each kind of value.  These counts
merge, so they are an ordinary streaming aggregate with a map-side part, and a busy window is as many groups as it has
different values.  A second aggregate puts a window's counts together once the watermark has passed it:
medians from counted values, distinct values as counted rows, means of whole numbers from sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from abuse_lens.functions.numbers import fraction
from abuse_lens.operators import rpc
from abuse_lens.streaming.ordered import use_rocksdb
from abuse_lens.streaming.windows import WINDOW_SEC, event_time


def _marks(stream: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(event_time, kind, value) for every value that is not null."""
    pairs = [F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value")) for kind, value in values.items()]
    return stream.select("event_time", F.explode(F.array(*pairs)).alias("m")).where("m.value is not null").select("event_time", "m.kind", "m.value")


def window_features(
    pairs: DataFrame, events: DataFrame | None = None, window_sec: int = WINDOW_SEC, lateness: str = "10 seconds"
) -> DataFrame:
    """All window features of a stream of pairs, by response completion, as ``rpc.response_aggregates`` gives them.

    ``events`` (ts_ns, dst_port, src_port) are the directed events whose ports are counted; a window
    without a pair has no row.  Whole numbers are exact up to 2^53.
    """
    c = F.col
    marks = _marks(
        event_time(pairs, "resp_completed_ns", lateness),
        {
            "pair": F.lit(1),
            "request": c("request_bytes"),
            "response": c("response_bytes"),
            "ratio": rpc.amp_ratio(),
            "duration": rpc.duration_ns(),
            "status": c("status_code"),
            "parsed": F.when(c("rpc_envelope_parsed"), 1),
            "code": F.when(c("rpc_envelope_parsed"), c("rpc_error_code")),
        },
    )
    if events is not None:
        ports = {"dst_port": c("dst_port"), "src_port": c("src_port")}
        marks = marks.unionByName(_marks(event_time(events, "ts_ns", lateness), ports))
    width = f"{window_sec} seconds"
    counted = marks.groupBy(F.window("event_time", width).alias("span"), "kind", "value").agg(F.count(F.lit(1)).alias("n"))

    def of(kind: str, value: Column) -> Column:
        return F.when(c("kind") == kind, value)

    def rows(kind: str, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(of(kind, c("n") if where is None else F.when(where, c("n")))), F.lit(0).cast("bigint"))

    def total(kind: str) -> Column:
        return F.sum(of(kind, c("value").cast("bigint") * c("n")))

    def most(kind: str) -> Column:
        return F.max(of(kind, c("value").cast("bigint")))

    def different(kind: str) -> Column:
        return F.least(F.count(of(kind, F.lit(1))), F.lit(rpc.DISTINCT_CAP))

    n, n_status = rows("pair"), rows("status")
    in_class = lambda low: rows("status", c("value").between(low, low + 99))
    again = F.window(F.window_time("span"), width).alias("again")
    features = counted.groupBy(again).agg(
        n.alias("count"),
        total("response").alias("resp_bytes_total"),
        most("request").alias("req_bytes_max"),
        most("response").alias("resp_bytes_max"),
        (total("request").cast("double") / n).alias("req_bytes_mean"),
        (total("response").cast("double") / n).alias("resp_bytes_mean"),
        (F.sum(of("ratio", c("value") * c("n"))) / rows("ratio")).alias("amp_ratio_mean"),
        F.max(of("ratio", c("value"))).alias("amp_ratio_max"),
        F.percentile(of("ratio", c("value")), F.lit(0.5), c("n")).alias("amp_ratio_median"),
        most("duration").alias("duration_ns_max"),
        F.when(rows("duration") > 0, F.call_function("div", total("duration"), F.greatest(rows("duration"), F.lit(1)))).alias("duration_ns_mean"),
        *[fraction(in_class(k), n_status).alias(f"status_{k // 100}xx_frac") for k in (200, 400, 500)],
        F.when(rows("parsed") > 0, different("code")).alias("rpc_error_distinct_codes"),
        F.when(rows("parsed") > 0, rows("code").cast("double") / n).alias("rpc_error_frac"),
        different("dst_port").alias("unique_dst_ports"),
        different("src_port").alias("unique_src_ports"),
    )
    return features.where("count > 0").select(F.unix_seconds("again.start").alias("window_start"), "*").drop("again")


class _EveryWindow(StatefulProcessor):
    """Passes finished windows on; a timer at the end of the next one tells that it was empty."""

    def __init__(self, width: int, columns: list[str]) -> None:
        self.width, self.columns = width, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "start bigint")

    def close(self) -> None:
        pass

    def _expect(self, start: int) -> None:
        self.next.update((start,))
        self.handle.registerTimer((start + self.width) * 1000)

    def _empty(self, begin: int, end: int) -> Iterator[Row]:
        for start in range(begin, end, self.width):
            yield Row(**{c: start if c == "window_start" else None for c in self.columns})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.next.get()
        expected = known[0] if known else None
        for row in sorted(rows, key=lambda r: r["window_start"]):
            start = row["window_start"]
            yield from self._empty(start if expected is None else expected, start)
            yield Row(**{c: row[c] for c in self.columns})
            expected = start + self.width
        if expected is not None:
            self._expect(expected)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expected, passed = self.next.get()[0], timerValues.getCurrentWatermarkInMs() // 1000
        if expiredTimerInfo.getExpiryTimeInMs() != (expected + self.width) * 1000:
            return  # set for a window that has come since
        upto = expected + max(0, passed - expected) // self.width * self.width
        yield from self._empty(expected, upto)
        self._expect(max(upto, expected))


def with_empty_windows(windows: DataFrame, span: str, window_sec: int = WINDOW_SEC) -> DataFrame:
    """Finished windows (a streaming aggregate over ``span``) with a row of nulls for every empty window between and behind them.

    One row a window meets here, whatever the stream carries.  The first window seen is the first given out.
    """
    use_rocksdb(windows.sparkSession)
    others = [f for f in windows.schema.fields if f.name != span]
    timed = windows.select(
        F.lit(0).alias("all"), F.window_time(span).alias("event_time"), F.unix_seconds(f"{span}.start").alias("window_start"), *[f.name for f in others]
    )
    schema = ", ".join(["window_start bigint", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others)])
    processor = _EveryWindow(window_sec, ["window_start", *(f.name for f in others)])
    return timed.groupBy("all").transformWithState(processor, schema, "append", "eventTime")
