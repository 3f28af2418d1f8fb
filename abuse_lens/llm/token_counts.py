"""Exact histogram of encoded lengths (operator 9).

Documents are encoded once; from then on only (length, documents) is left, and
suffix sums over it answer totals, quantiles and truncated totals for every
context limit without another look at the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abuse_lens.plans.settle import settle

BUCKET = 256


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_lengths(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of every row's whole text; a null text has 0 tokens."""

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(lengths, f"doc_id {kind}, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and docs: how many rows have exactly that length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: docs, docs_at_least, tokens_at_least, truncated_total, share_at_most.

    ``truncated_total`` is the tokens left when every document is cut to that
    length; ``share_at_most`` the share of documents no longer than it, so the
    q-quantile is the smallest length whose share is at least q.  Lengths are
    summed in buckets first, so that only one row per ``BUCKET`` lengths meets in
    one task.  The histogram, which is small, is written first: what counts it runs once.  No rows in, no rows out.
    """
    hist = settle(hist)
    tokens = F.col("n_tokens") * F.col("docs")
    cut = hist.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = cut.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))
    buckets = buckets.select(
        "bucket",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.select("*", F.sum("docs").over(inside).alias("d"), F.sum(tokens).over(inside).alias("t"))
        .join(buckets, "bucket")
        .select(
            "n_tokens",
            "docs",
            (F.col("d") + F.col("docs_after")).alias("docs_at_least"),
            (F.col("t") + F.col("tokens_after")).alias("tokens_at_least"),
            "all_docs",
            "all_tokens",
        )
        .select(
            "n_tokens", "docs", "docs_at_least", "tokens_at_least",
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
            .alias("truncated_total"),
            ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("share_at_most"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """One row per limit: documents longer than it, their tokens, and the tokens left when all are cut to it.

    A limit between two lengths is answered from the next longer one.
    """
    longer = F.col("n_tokens") > F.col("limit_tokens")
    first = F.struct("n_tokens", "docs_at_least", "tokens_at_least")
    n = F.col("l.docs_at_least")
    return (
        sums.select("*", F.explode(F.array(*[F.lit(x).cast("bigint") for x in limits])).alias("limit_tokens"))
        .groupBy("limit_tokens")
        .agg(
            F.min_by(F.when(longer, first), F.when(longer, F.col("n_tokens"))).alias("l"),
            F.max("tokens_at_least").alias("total_tokens"),
        )
        .select(
            "limit_tokens",
            "total_tokens",
            F.coalesce(n, F.lit(0)).alias("docs_longer"),
            F.coalesce("l.tokens_at_least", F.lit(0)).alias("tokens_longer"),
            (F.col("total_tokens") - F.coalesce("l.tokens_at_least", F.lit(0)) + F.col("limit_tokens") * F.coalesce(n, F.lit(0)))
            .alias("truncated_total"),
        )
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share ``q`` of documents does not exceed."""
    return sums.where(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))
