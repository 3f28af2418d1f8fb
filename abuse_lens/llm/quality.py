"""Quality by perplexity under a Kneser-Ney model of trusted text (operator 2).

Counts of n-grams over all trusted text give an interpolated modified
Kneser-Ney model; every document's perplexity under it is compared with
quantiles of the trusted documents of its language.

The symbols are the bytes themselves, so the model grows with the text.  Counts,
continuation counts, shares and spares are Spark tables dealt by context; no task and no
driver holds the model.  Documents are dealt to chunks once, as a bucketed table.  A chunk
asks for its different n-grams only; these are joined with the model by context, order by
order, and go back to the chunk, which sums them up per document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.llm.shingles import slices
from abuse_lens.plans.settle import files_for, settle, shared_folder

#: A symbol takes nine bits: the 256 bytes and what stands before a document's first one.
ORDER, BITS = 4, 9
SYMBOLS = 1 << BITS
#: Text that a task turns into codes at once; each byte takes some fifty more there.
SLICE_BYTES = 250_000
#: Text of a chunk, on average: a task holds it a few times over, on either side of the pipe to Python.
CHUNK_BYTES = 8_000_000
#: Chunks of a bucket, on average, and the most buckets that chunks are dealt to; a bucket is sorted by chunk and may spill.
BUCKET_CHUNKS, BUCKETS = 5, 512
#: Scored rows of an Arrow batch.
BATCH_ROWS = 1000


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of every byte, one for each; 0 stands before a document's first byte."""
    return np.arange(1, 257, dtype=np.int64)


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram code that ends at every byte of all texts in a row, and where each text's begin."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    begins = offsets - offsets[0]
    one = symbols()[raw]
    since = np.arange(len(one)) - np.repeat(begins[:-1], np.diff(begins))
    code = one.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(one)
        before[k:] = one[: max(0, len(one) - k)]
        before[since < k] = 0
        code |= before << (BITS * k)
    return code, begins


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of all texts, in order, and how often each occurs."""
    found, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in slices(texts, SLICE_BYTES):
        places, names = pd.factorize(codes(texts.slice(a, b - a))[0])
        found.append(names)
        times.append(np.bincount(places, minlength=len(names)))
    code, place = np.unique(np.concatenate(found), return_inverse=True)
    return code, np.bincount(place, np.concatenate(times), len(code)).astype(np.int64)


def _texts(rows: pa.Table | pa.RecordBatch) -> pa.Array:
    texts = rows.column("text").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks or [pa.array([], pa.large_string())])
    return pc.fill_null(texts, "")


def count(trusted: DataFrame) -> DataFrame:
    """code and n over the whole texts of all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _counted(_texts(batch))], ["code", "n"])

    grams = trusted.select("text").mapInArrow(counted, "code long, n long")
    return grams.groupBy("code").agg(F.sum("n").alias("n"))


def _followed(grams: DataFrame) -> DataFrame:
    """Of every context of ``grams(context, symbol, n)``: how often each symbol follows it, their sum, and how many do so 1, 2, 3 and 4 times."""
    summed = grams.groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    times = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    after = F.map_from_entries(F.collect_list(F.struct("symbol", "n")))
    return summed.groupBy("context").agg(after.alias("after"), F.sum("n").alias("total"), *times)


def _level(followed: DataFrame) -> DataFrame:
    """Of every context: spare, and the shares of the symbols seen after it, discounted."""
    n1, n2, n3, n4 = (n or 0.5 for n in followed.agg(*(F.sum(f"n{i}") for i in (1, 2, 3, 4))).first())
    y = n1 / (n1 + 2 * n2)
    discounts = [min(max(d, 0.05), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    once, twice, more = map(F.lit, discounts)
    off = once * F.col("n1") + twice * F.col("n2") + more * (F.size("after") - F.col("n1") - F.col("n2"))
    shares = F.transform_values(
        "after", lambda _, n: (n - F.when(n == 1, once).when(n == 2, twice).otherwise(more)) / F.col("total")
    )
    return followed.select("context", (off / F.col("total")).alias("spare"), shares.alias("shares"))


def fit(grams: DataFrame) -> dict[int, DataFrame]:
    """The model of n-grams ``(code, n)``, counts of one code add up: per order context, spare and shares by symbol."""
    symbol = F.col("code").bitwiseAND(F.lit(SYMBOLS - 1)).cast("int").alias("symbol")
    grams, model = grams.select(F.shiftright("code", BITS).alias("context"), symbol, "n"), {}
    for order in range(ORDER, 0, -1):
        followed = settle(_followed(grams), files_for(SYMBOLS ** (order - 1)))
        model[order] = _level(followed)
        if order > 1:  # below the highest order a gram counts once for each symbol seen before it
            shorter = F.col("context").bitwiseAND(F.lit((1 << (BITS * (order - 2))) - 1)).alias("context")
            grams = followed.select(shorter, F.explode(F.map_keys("after")).alias("symbol"), F.lit(1).alias("n"))
    return model


def train(trusted: DataFrame) -> dict[int, DataFrame]:
    """The model of the texts of all rows."""
    return fit(count(trusted))


def surprises(grams: DataFrame, model: dict[int, DataFrame]) -> DataFrame:
    """code and bits, minus the natural logarithm of its probability, of the different ``code`` of all rows."""
    grams, lower = settle(grams.select("code").distinct(), files_for(grams.count())), None
    for order in range(1, ORDER + 1):
        last = F.col("code").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
        shorter = F.col("code").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))
        some = grams.select(last.alias("code")).distinct() if order < ORDER else grams
        some = some.select("code", F.shiftright("code", BITS).alias("context"), shorter.alias("_shorter"))
        some = some.withColumn("_lower", F.lit(1 / SYMBOLS)) if lower is None else some.join(lower, "_shorter")
        symbol = F.col("code").bitwiseAND(F.lit(SYMBOLS - 1)).cast("int")
        share = F.coalesce(F.element_at("shares", symbol), F.lit(0.0))
        # a context never seen leaves all to the lower order
        p = share + F.coalesce("spare", F.lit(1.0)) * F.col("_lower")
        found = some.join(model[order], "context", "left").select("code", p.alias("_lower"))
        lower = found.withColumnRenamed("code", "_shorter")
    return found.select("code", (-F.log(F.greatest("_lower", F.lit(1e-12)))).cast("float").alias("bits"))


class Surprise:
    """A small model's values by n-gram code, fetched to be looked at; scoring joins instead."""

    def __init__(self, model: dict[int, DataFrame]) -> None:
        self.levels = {o: {r.context: (r.spare, r.shares) for r in m.collect()} for o, m in model.items()}

    def __len__(self) -> int:
        return 1 << (BITS * ORDER)

    def __getitem__(self, code: int | slice):
        if isinstance(code, slice):
            return np.array([self[c] for c in range(*code.indices(len(self)))])
        p = 1 / SYMBOLS
        for order in range(1, ORDER + 1):
            part = int(code) & ((1 << (BITS * order)) - 1)
            spare, shares = self.levels[order].get(part >> BITS, (1.0, {}))
            p = shares.get(part & (SYMBOLS - 1), 0.0) + spare * p
        return -np.log(max(p, 1e-12))


def surprise(model: dict[int, DataFrame]) -> Surprise:
    """Minus the natural logarithm of the probability of any n-gram code under a small model."""
    return Surprise(model)


def _chunk(chunks: int) -> Column:
    place = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.pmod(place, F.lit(chunks)).cast("int")


def deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with _chunk, written once as a table bucketed by it, and the number of chunks.

    Rows of one doc_id share a chunk; rows without one, which are never trusted, are dealt by their text.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-size // CHUNK_BYTES) or 1
    dealt = docs.withColumn("_chunk", F.coalesce(_chunk(chunks), F.pmod(F.xxhash64("text"), F.lit(chunks)).cast("int")))
    name = f"dealt_{uuid.uuid4().hex}"
    writer = dealt.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(min(-(-chunks // BUCKET_CHUNKS), BUCKETS), "_chunk").saveAsTable(name)
    return spark.table(name), chunks


def occurrences(dealt: DataFrame, ids: DataFrame, chunks: int) -> DataFrame:
    """The different codes of every chunk, and n, how often each occurs in texts whose doc_id is in ``ids``."""

    def found(rows: pa.Table, trusted: pa.Table) -> pa.Table:
        known = pc.is_in(rows.column("doc_id"), value_set=trusted.column("doc_id").combine_chunks())
        code, n = _counted(_texts(rows.filter(known)))
        other = _counted(_texts(rows.filter(pc.invert(known))))[0]
        other = other[~np.isin(other, code)]
        code, n = np.append(code, other), np.append(n, np.zeros(len(other), np.int64))
        chunk = (rows if len(rows) else trusted).column("_chunk")[0].as_py()
        return pa.table({"_chunk": pa.array(np.full(len(code), chunk, np.int32)), "code": code, "n": n})

    texts = dealt.select("_chunk", "doc_id", "text").groupBy("_chunk")
    ids = ids.select(F.col("doc_id").cast(dealt.schema["doc_id"].dataType)).withColumn("_chunk", _chunk(chunks))
    return texts.cogroup(ids.groupBy("_chunk")).applyInArrow(found, "_chunk int, code long, n long")


def perplexities(dealt: DataFrame, found: DataFrame, bits: DataFrame, keep_text: bool = False) -> DataFrame:
    """All columns (but text, unless kept) of every row, with _symbols and _perplexity (1 for a text without symbols)."""
    others = [f for f in dealt.schema.fields if f.name != "_chunk" and (keep_text or f.name != "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)

    def scored(rows: pa.Table, grams: pa.Table) -> pa.Table:
        known, bits = (grams.column(c).to_numpy() for c in ("code", "bits"))
        order = np.argsort(known)
        known, bits = known[order], bits[order].astype(np.float64)
        texts = _texts(rows)
        parts = [(np.zeros(0), np.zeros(0, np.int64))]
        for a, b in slices(texts, SLICE_BYTES):
            code, begins = codes(texts.slice(a, b - a))
            places, names = pd.factorize(code)
            ends = np.concatenate([[0], np.cumsum(bits[np.searchsorted(known, names)][places])])[begins]
            parts.append((np.diff(ends), np.diff(begins)))
        total, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        columns = [*(rows.column(f.name) for f in others), pa.array(n), pa.array(np.exp(total / np.maximum(n, 1)))]
        found = pa.table(columns, [*(f.name for f in others), "_symbols", "_perplexity"])
        return pa.Table.from_batches(found.to_batches(BATCH_ROWS), found.schema)

    asked = found.select("_chunk", "code").join(bits, "code").groupBy("_chunk")
    return dealt.groupBy("_chunk").cogroup(asked).applyInArrow(scored, f"{schema}, _symbols long, _perplexity double")


def band() -> Column:
    """Texts of like length vary alike: 0 below 64 symbols, then one more for each doubling, up to 6."""
    return F.greatest(F.lit(0), F.least(F.lit(6), F.floor(F.log2(F.greatest("_symbols", F.lit(1)))) - 5)).cast("int")


@dataclass(frozen=True)
class Limits:
    """The highest perplexity to keep: by language and length band, by language, of all."""

    near: DataFrame
    wide: DataFrame
    every: float | None


def limits(scored: DataFrame, ids: DataFrame, quantile: float, margin: float, least: int) -> Limits:
    """Quantiles of the trusted among ``scored(doc_id, lang, _symbols, _perplexity)``."""
    cut = (F.percentile_approx("_perplexity", quantile, 10000) * margin).alias("limit")
    trusted = scored.select("doc_id", "lang", "_symbols", "_perplexity").join(ids, "doc_id", "left_semi").where("_symbols > 0").withColumn("_band", band())
    # one pass for all three: by language and length band, by language, of all
    found = trusted.rollup("lang", "_band").agg(F.grouping_id().alias("_of"), cut, (F.count("*") >= least).alias("enough"))
    found = settle(found, files=1)  # a row for each language and band
    near = found.where("_of = 0 and enough").select("lang", "_band", "limit")
    wide = found.where("_of = 1 and enough").select("lang", "limit")
    every = found.where("_of = 3").first()
    return Limits(near, wide, every and every.limit)


def learn(
    docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.995, margin: float = 1.1, least: int = 30, keep_text: bool = False
) -> tuple[Limits, DataFrame]:
    """The limits that follow from the trusted texts, and every row with its perplexity under their model."""
    ids = trusted_ids.select("doc_id").where("doc_id is not null").distinct()
    dealt, chunks = deal(docs)
    found = settle(occurrences(dealt, ids, chunks))
    model = fit(found.where("n > 0"))
    scored = settle(perplexities(dealt, found, surprises(found, model), keep_text))
    return limits(scored, ids, quantile, margin, least), scored


def judge(scored: DataFrame, limits: Limits) -> DataFrame:
    """``scored`` with ceiling (null if nothing is trusted) and keep."""
    near = limits.near.withColumnsRenamed({"lang": "_near_lang", "_band": "_near_band", "limit": "_near"})
    wide = limits.wide.withColumnsRenamed({"lang": "_wide_lang", "limit": "_wide"})
    found = (
        scored.withColumn("_band", band())
        .join(near, F.col("lang").eqNullSafe(F.col("_near_lang")) & (F.col("_band") == F.col("_near_band")), "left")
        .join(wide, F.col("lang").eqNullSafe(F.col("_wide_lang")), "left")
        .withColumn("ceiling", F.coalesce("_near", "_wide", F.lit(limits.every).cast("double")))
    )
    return found.withColumn("keep", F.coalesce(F.col("_perplexity") <= F.col("ceiling"), F.lit(True)))


def classify(
    docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.995, margin: float = 1.1, least: int = 30
) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, ceiling and keep for every row of ``docs(doc_id, text, lang)``.

    The model is trained on all rows whose doc_id is in ``trusted_ids``.  A text is
    kept if its perplexity is at most ``margin`` times the ``quantile`` of trusted texts of
    its language and length band; where these are fewer than ``least``, of its
    language; where these are, of all.  A null language is a language.  Texts
    without symbols are kept: they are as any trusted one.  Without trusted text all
    are kept, with a null ceiling.
    """
    found, scored = learn(docs.select("doc_id", "text", "lang"), trusted_ids, quantile, margin, least)
    columns = ["doc_id", "lang", F.col("_symbols").alias("n_symbols"), F.col("_perplexity").alias("perplexity"), "ceiling", "keep"]
    return judge(scored, found).select(*columns)
