"""Retention of hourly partitions by age and by number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FILES = 3600
MAX_AGE_SEC = 86400


def verdicts(
    files: DataFrame, ts: str, now: int, max_age_sec: int = MAX_AGE_SEC, max_files: int = MAX_FILES, names: list[str] | None = None
) -> DataFrame:
    """Keep or remove each file: too old goes first, then the oldest above the limit.

    ``names`` are the columns that tell files of one time apart (by default all
    others); of these the largest name is the newest.  The least of the newest
    ``max_files`` young files is found by a top-k; every file is compared with it.
    """
    place = F.struct(ts, *(names if names is not None else [c for c in files.columns if c != ts]))
    age = F.greatest(F.lit(now).cast("bigint") - F.col(ts), F.lit(0).cast("bigint"))
    young = files.where(age <= max_age_sec)
    newest = young.select(place.alias("place")).distinct().orderBy(F.desc("place")).limit(max_files)
    least = newest.agg(F.min("place")).scalar()
    return files.withColumn(
        "verdict",
        F.when(age > max_age_sec, "removed_by_age").when(place >= least, "kept").otherwise("removed_by_count"),
    )
