"""Difference of two results: expected against actual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side only, with how many more times they occur there.

    Both sides are counted in one aggregate instead of two ``exceptAll`` passes.
    """
    columns = expected.columns
    sides = expected.select(*columns, F.lit(1).alias("_side")).unionByName(
        actual.select(*columns, F.lit(-1).alias("_side"))
    )
    return (
        sides.groupBy(*columns)
        .agg(F.sum("_side").alias("_extra"))
        .where(F.col("_extra") != 0)
        .select(
            *columns,
            F.when(F.col("_extra") > 0, "expected").otherwise("actual").alias("only_in"),
            F.abs("_extra").alias("copies"),
        )
    )


def first_difference(expected: DataFrame, actual: DataFrame, line: str = "line_no", text: str = "value") -> DataFrame:
    """The first line (by number) on which two documents differ."""
    e = expected.select(line, F.col(text).alias("expected"))
    a = actual.select(line, F.col(text).alias("actual"))
    both = e.join(a, line, "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual"))).orderBy(line).limit(1)
