"""A table of stream batches that holds each batch once, whatever is repeated.

A batch is written to a folder of its own for this attempt; then one manifest row
names the attempt.  Readers take named attempts alone.  What a lost driver or a
repeated batch leaves without a manifest is never read, and a batch that has its
manifest is not written again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from abuse_lens.sinks import files

_PLACE = ["batch", "attempt"]
_MANIFEST = "batch bigint, attempt string"


class BatchTable:
    """Rows of a stream under ``root``, partitioned by ``keys`` within a batch.

    ``rows/batch=N/attempt=X`` holds rows, ``manifest/batch=N`` one row that names the
    attempt that counts.  One stream with one checkpoint writes to a root: batch
    numbers tell its batches apart.  Columns must not be named ``batch`` or ``attempt``.
    """

    def __init__(self, root: str, keys: list[str]):
        self.root, self.keys = root, keys

    def write(self, rows: DataFrame, batch: int) -> None:
        """One batch, for ``foreachBatch``; a batch that is committed is left as it is."""
        if self.committed(rows.sparkSession, batch):
            return
        attempt = uuid.uuid4().hex
        self.put(rows, batch, attempt)
        self.commit(rows.sparkSession, batch, attempt)

    def committed(self, spark: SparkSession, batch: int) -> bool:
        return bool(files.directly_in(spark, f"{self.root}/manifest/batch={batch}", ".parquet"))

    def put(self, rows: DataFrame, batch: int, attempt: str) -> None:
        """Write the rows; the rebalance gathers small partitions and splits large ones."""
        clash = sorted(set(_PLACE) & {c.lower() for c in rows.columns})
        if clash:
            raise ValueError(f"columns named as the table's own: {clash}")
        folder = f"{self.root}/rows/batch={batch}/attempt={attempt}"
        rows.hint("rebalance", *[F.col(k) for k in self.keys]).write.partitionBy(*self.keys).parquet(folder)

    def commit(self, spark: SparkSession, batch: int, attempt: str) -> None:
        """One file, which appears whole: the batch counts from then on."""
        row = spark.range(0, 1, 1, 1).select(F.lit(attempt).alias("attempt"))
        row.write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run the stream into this table."""
        writer = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start()

    def manifest(self, spark: SparkSession) -> DataFrame:
        """Batches that count, with the attempt of each; no rows before the first one."""
        if not files.exists(spark, f"{self.root}/manifest"):
            return spark.createDataFrame([], _MANIFEST)
        return spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """Rows of committed batches with their ``batch``; ``schema`` names the rows' columns, keys included."""
        if not files.exists(spark, f"{self.root}/rows"):
            return spark.createDataFrame([], f"{schema}, batch bigint")
        every = spark.read.schema(f"{schema}, {_MANIFEST}").parquet(f"{self.root}/rows")
        return every.join(self.manifest(spark), _PLACE, "left_semi").drop("attempt")

    def remove_abandoned(self, spark: SparkSession) -> int:
        """Delete attempts that no manifest names, of committed batches only: others may still be written."""
        kept = {r["batch"]: r["attempt"] for r in self.manifest(spark).toLocalIterator()}
        gone = 0
        for batch, attempt in kept.items():
            folder = f"{self.root}/rows/batch={batch}"
            for other in files.partition_values(spark, folder, "attempt"):
                gone += other != attempt and files.remove(spark, f"{folder}/attempt={other}")
        return gone
