"""Write an intermediate that several consumers share, and cut its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine's own disk would be lost with the machine.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="abuse-lens-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def files_for(rows: int, each: int = 100_000) -> int:
    """As many files as so many rows need, and a few for the least."""
    return 4 + rows // each


def settle(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there.

    The copy survives lost executors, is pruned to the columns a consumer needs
    and has a known size, so joins against it are planned on facts.  Where the rows are
    counted or bounded, ``files`` is the most files to write, however many
    partitions a shuffle has.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
