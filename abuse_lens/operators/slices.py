"""Ordered window functions whose groups are cut into slices.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts every row of a key in one
task, so one key holding a third of the table becomes one task holding a third
of the table.  Here the window runs per (key, slice); one edge row per
(key, slice) goes to a second, small window per key, and what it carries over
is joined back on the columns the rows are already partitioned by.  The result
is the same as the plain window's.

``slice`` must grow with the ordering, e.g. a time column divided by a width.
Key and slice columns must not be null (they are made so by ``with_slice`` and
by the callers): then no filter is inferred on either side of the join, both
sides ask for the same shuffle of the rows, and Spark runs it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = "_slice_"
_NULL_SLICE = -(2**62)


def slice_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PREFIX)]


def without_slices(df: DataFrame) -> DataFrame:
    return df.drop(*slice_columns(df))


def with_slice(df: DataFrame, position: str, width: int) -> tuple[DataFrame, str]:
    """Add the slice number of an integer position column (floor division).

    Returns the table and the name of the column, which tells position and
    width: the same slices are found again further down a chain of operators,
    and rows partitioned by them need not be shuffled again.
    """
    name = f"{PREFIX}{position.lstrip('_')}_{width}"
    if name in df.columns:
        return df, name
    p, w = F.col(position).cast("bigint"), F.lit(width).cast("bigint")
    number = F.call_function("div", p - F.pmod(p, w), w)
    return df.withColumn(name, F.coalesce(number, F.lit(_NULL_SLICE).cast("bigint"))), name


def never_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill integer key columns with -1; Spark drops this where they cannot be null."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(c, F.lit(-1).cast(kinds[c])) for c in columns})


def lag_in_slices(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_col: str,
    columns: list[str],
    into: str = "prev",
) -> DataFrame:
    """Add ``into``: a struct of ``columns`` of the key's previous row, null on its first."""
    cut = [*keys, slice_col]
    by_slice = Window.partitionBy(*cut).orderBy(*order)
    whole = F.struct(*[c for c in df.columns if c not in cut])
    local = df.select("*", F.lag(F.struct(*columns)).over(by_slice).alias("_slice_local"), whole.alias("_slice_whole"))
    local = local.withColumn("_slice_next", F.lead(F.lit(1)).over(by_slice))
    edges = (
        local.where(F.col("_slice_next").isNull())
        .select(*cut, F.struct(*[F.col(f"_slice_whole.{c}").alias(c) for c in columns]).alias("_slice_edge"))
        .withColumn("_slice_edge", F.lag("_slice_edge").over(Window.partitionBy(*keys).orderBy(slice_col)))
    )
    joined = local.drop("_slice_whole", "_slice_next").join(edges, cut, "left")
    return joined.withColumn(into, F.coalesce("_slice_local", "_slice_edge")).drop("_slice_local", "_slice_edge")


def _plus(local: Column, before: Column) -> Column:
    return local + F.coalesce(before, F.lit(0).cast("bigint"))


_RUNNING = {"sum": (F.sum, _plus), "max": (F.max, F.greatest)}


def running_in_slices(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_col: str,
    values: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add running ``sum`` / ``max`` columns, the current row included.

    ``values`` maps the new column to (function, expression).
    """
    cut = [*keys, slice_col]
    by_slice = Window.partitionBy(*cut).orderBy(*order)
    running = by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*",
        *[_RUNNING[fn][0](e).over(running).alias(n) for n, (fn, e) in values.items()],
        F.lead(F.lit(1)).over(by_slice).alias("_slice_next"),
    )
    edges = local.where(F.col("_slice_next").isNull()).select(
        *cut, *[_RUNNING[fn][0](n).over(before).alias(f"_{n}") for n, (fn, _) in values.items()]
    )
    joined = local.drop("_slice_next").join(edges, cut, "left")
    combined = {n: _RUNNING[fn][1](F.col(n), F.col(f"_{n}")) for n, (fn, _) in values.items()}
    return joined.withColumns(combined).drop(*[f"_{n}" for n in values])


def row_number_in_slices(
    df: DataFrame, keys: list[str], order: list[str], slice_col: str, into: str = "rn"
) -> DataFrame:
    """Number the rows of a key from 1.

    A slice starts behind the rows of the slices before it, and these are only
    counted: the rows themselves are shuffled and sorted once.
    """
    cut = [*keys, slice_col]
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*cut).agg(F.count(F.lit(1)).alias("_slice_rows"))
    starts = counts.select(*cut, F.coalesce(F.sum("_slice_rows").over(before), F.lit(0)).alias("_slice_start"))
    inside = F.row_number().over(Window.partitionBy(*cut).orderBy(*order))
    numbered = df.withColumn("_slice_rn", inside).join(starts, cut)
    return numbered.withColumn(into, F.col("_slice_rn") + F.col("_slice_start")).drop("_slice_rn", "_slice_start")


#: Rows that a task hands back at a time.
HANDED = 1024
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _arrow_schema(schema: str) -> pa.Schema:
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    kinds = {n: t.removeprefix("array<").removesuffix(">") for n, t in fields}
    return pa.schema([(n, pa.list_(_ARROW[kinds[n]]) if t != kinds[n] else _ARROW[t]) for n, t in fields])


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Each key and its columns, out of batches sorted by key."""
    key, held = None, {}
    for batch in batches:
        lists = batch.to_pydict()
        marks = list(zip(*[lists.pop(k) for k in keys], strict=True))
        ends = [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]] + [len(marks)] * bool(marks)
        for a, b in pairwise([0, *ends]):
            if marks[a] == key:
                for name, values in lists.items():
                    held[name] += values[a:b]
                continue
            if key is not None:
                yield key, held
            key, held = marks[a], {name: values[a:b] for name, values in lists.items()}
    if key is not None:
        yield key, held


def in_runs(df: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, dict], Iterable[tuple]], schema: str) -> DataFrame:
    """``work(key, columns)`` for the rows of each key, in order; the tuples it gives are rows of ``schema``.

    A task goes over its sorted rows and holds one key's rows and one batch, so many short keys cost
    little more than their rows; one key's rows must fit in a task.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, made = _arrow_schema(schema), []
        handed = lambda: pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(zip(*made, strict=True), kinds.types, strict=True)], schema=kinds
        )
        for key, held in _runs(batches, keys):
            made += work(key, held)
            if len(made) >= HANDED:
                yield handed()
                made = []
        if made:
            yield handed()

    ordered = [F.col(c).asc_nulls_last() for c in order]
    return df.repartition(*keys).sortWithinPartitions(*keys, *ordered).mapInArrow(each, schema)
