"""Counters of a running stream, batch by batch, in a table.

The counters ride along with the rows (``observe``), so they cost no pass of their own; a listener on the
driver gets one row of sums per batch and appends it to the table.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

NAME = "event_quality"
COUNTERS = ("events", "decode_errors", "events_filtered")
TABLE = "run_id string, batch_id bigint, at string, events bigint, decode_errors bigint, events_filtered bigint, late bigint"


def observed(events: DataFrame, defect: Column, direction: Column) -> DataFrame:
    """The usable events of a stream; all, rejected and unwatched ones are counted per batch."""
    marked = events.withColumns({"_defect": defect, "_way": direction})
    bad, unwatched = F.col("_defect").isNotNull(), F.col("_defect").isNull() & F.col("_way").isNull()
    counts = [F.count(F.lit(1)), F.count_if(bad), F.count_if(unwatched)]
    counted = marked.observe(NAME, *[c.alias(n) for c, n in zip(counts, COUNTERS, strict=True)])
    return counted.where(~bad & ~unwatched).drop("_defect", "_way")


class BatchCounters(StreamingQueryListener):
    """Appends a row per batch of every observed stream of the session to the Parquet table at ``path``.

    A batch that is run again after a failure has its batch_id again; ``read`` counts it once.  ``late`` are
    the rows that came behind the watermark.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run_id: str) -> threading.Event:
        return self.ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(NAME)
        if found is None or not progress.numInputRows:
            return
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        row = (str(progress.id), progress.batchId, progress.timestamp, *[found[c] for c in COUNTERS], late)
        self.spark.createDataFrame([row], TABLE).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, run_id: str, seconds: float = 60) -> bool:
        """Whether all batches of a run that has ended are in the table: events arrive behind the run."""
        return self._end(run_id).wait(seconds)

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(TABLE).parquet(self.path)
        return rows.dropDuplicates(["run_id", "batch_id"])
