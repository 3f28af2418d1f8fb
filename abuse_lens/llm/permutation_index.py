"""Nearest neighbours by a permutation index (operator 10).

Every vector is described by its nearest pivots in order.  A block of vectors
posts its members in the inverted files of their pivots; a query reads the files
of its own pivots, ranks the block by the footrule distance of the two orders,
and compares the nearest share of the block exactly.

Queries and vectors are both cut into blocks of bounded size and meet block by
block, so a task holds two blocks, whatever the input.  Only the pivots, a sample
of fixed size, are on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abuse_lens.plans.settle import settle

BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part.

    Left out are null vectors, those with a null, infinite or undefined
    component, those of zeros only, and those of another than the most frequent
    length.  Of rows with one vec_id the least vector counts; a null vec_id does not take part.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = (
        vectors.select("vec_id", x.cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )
    good = settle(good.withColumn("n", F.size("embedding")))
    common = good.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return good.where(F.col("n") == (common.n if common else 0)).drop("n")


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """``count`` different vectors (all, if fewer), the same ones for the same input."""
    distinct = vectors.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"))
    rows = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    return np.array([r.embedding for r in rows], np.float64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _orders(matrix: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    return np.argsort(-(matrix @ pivots.T), axis=1, kind="stable")[:, :prefix]


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
    pivots: np.ndarray, prefix: int, share: float, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): up to ``k`` found for each query in this block.

    Equal vectors are one entry of the index and share their place in it.
    """
    order = np.lexsort((ids,))
    ids, vectors = ids[order], vectors[order]
    unique, inverse = np.unique(vectors, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by_entry = np.argsort(inverse, kind="stable")
    begins = np.searchsorted(inverse[by_entry], np.arange(len(unique) + 1))

    prefix = min(prefix, len(pivots))
    orders = _orders(unique, pivots, prefix)
    # the inverted file of a pivot: entries, and how near the pivot is to them
    flat = orders.ravel()
    posted = np.argsort(flat, kind="stable")
    files = np.searchsorted(flat[posted], np.arange(len(pivots) + 1))
    entries, nearness = posted // prefix, (prefix - posted % prefix).astype(np.int32)
    tried = min(len(unique), max(2 * k + 2, int(np.ceil(share * len(unique)))))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query_id, query, pivot_order in zip(query_ids, queries, _orders(queries, pivots, prefix), strict=True):
        # footrule = constant - 2 * sum over common pivots of the smaller nearness
        common = np.zeros(len(unique), np.int32)
        for place, pivot in enumerate(pivot_order):
            a, b = files[pivot], files[pivot + 1]
            common[entries[a:b]] += np.minimum(nearness[a:b], prefix - place)
        near = np.argpartition(-common, tried - 1)[:tried] if tried < len(unique) else np.arange(len(unique))
        scores = (unique[near] * query).sum(1)
        best = np.argsort(-scores, kind="stable")[: k + 1]
        least = scores[best[-1]]
        best = np.flatnonzero(scores >= least)  # all that tie with the last
        # the smallest ids of each entry are enough: one may be the query's own
        rows = [by_entry[begins[e] : begins[e] + min(k + 1, begins[e + 1] - begins[e])] for e in near[best]]
        sizes = np.array([len(r) for r in rows])
        found, score = ids[np.concatenate(rows)], np.repeat(scores[best], sizes)
        other = found != query_id
        found, score = found[other], score[other]
        first = np.lexsort((found, -score))[:k]
        out.append((np.full(len(first), query_id), found[first], score[first]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0), np.zeros(0), np.zeros(0)]
    return columns[0], columns[1], columns[2]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20,
    pivots: int = 256, prefix: int = 64, share: float = 0.2,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` largest inner products found per query.

    ``queries`` and ``vectors`` have vec_id and embedding, as ``usable`` returns
    them.  A query's own vec_id is no candidate of it; ties go to the smaller
    vec_id; fewer candidates than ``k`` are all returned.  ``share`` of each block
    is compared exactly.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    n_vectors, n_queries = vectors.count(), queries.count()
    if not n_vectors or not n_queries:
        return spark.createDataFrame([], schema)
    chosen = spark.sparkContext.broadcast(choose_pivots(vectors, pivots))
    blocks, query_blocks = -(-n_vectors // BLOCK_VECTORS), -(-n_queries // BLOCK_QUERIES)

    def dealt(table: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
        return table.select("vec_id", "embedding", block.alias(own)).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            columns = search_block(
                left["vec_id"].to_numpy(), _matrix(left["embedding"]),
                right["vec_id"].to_numpy(), _matrix(right["embedding"]), chosen.value, prefix, share, k,
            )
        else:
            columns = (np.zeros(0), np.zeros(0), np.zeros(0))
        kinds = (pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds, strict=True)]
        return pa.Table.from_arrays(arrays, ["query_id", "vec_id", "score"])

    left = dealt(queries, "query_block", query_blocks, "block", blocks).groupBy("block", "query_block")
    right = dealt(vectors, "block", blocks, "query_block", query_blocks).groupBy("block", "query_block")
    found = left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """What ``search`` aims at, for checks on small tables."""
    rows = []
    for query_id, query in zip(query_ids, vectors[np.searchsorted(ids, query_ids)], strict=True):
        scores = (vectors * query).sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query_id][:k]
        rows += [(query_id, r + 1, ids[i], scores[i]) for r, i in enumerate(order)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
