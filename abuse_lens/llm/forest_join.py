"""N-gram Jaccard join by banded MinHash (operator 8).

Equal texts are one class from the start.  Each tree holds the texts under one
prefix of minima; two texts are candidates if they share that prefix in some
tree.  All prefixes have one length, computed from the threshold, the trees and
the target recall before any row is read: this is banding, not an LSH forest that
matches prefixes of several lengths.  A pair at the threshold that no other
text chains together is lost with the probability that the recall leaves.

Candidates are never listed as pairs: those that share a prefix hang together in
a component, and a component is compared inside blocks of bounded size by its
shared shingles, exactly.  Every block returns, per text, how many links it has
there and one link into its group, so the output grows with the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.llm import shingles
from abuse_lens.llm.components import connected_components
from abuse_lens.plans.settle import files_for, settle

#: Texts of a component that are compared at once, and their characters.
BLOCK_TEXTS, BLOCK_CHARS = 512, 4_000_000
#: From so many holders on, a shingle is counted by a matrix product instead of one by one.
COMMON = 24


def prefix_length(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is met in some tree with probability ``recall``.

    A formula of the four numbers, the same for every text; one minimum is the shortest.
    """
    length = deepest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def _signed(docs: DataFrame, width: int, trees: int, length: int) -> DataFrame:
    """doc_id, text_key, n_chars and prefixes (one per tree; none for a text without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            for a, b in shingles.slices(texts):
                part = texts.slice(a, b - a)
                values, begins = shingles.of_texts(part, width)
                rows = shingles.minhash(values, begins, trees * length)
                has = np.diff(begins) > 0
                flat = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(4 * length), rows.shape[0] * trees, [None, pa.py_buffer(rows.astype("<u4").tobytes())]
                ).cast(pa.binary())
                offsets = np.concatenate([[0], np.cumsum(has * trees)]).astype(np.int32)
                keys = [hashlib.md5(t.encode()).digest() for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(keys, pa.binary()),
                        pc.utf8_length(part).cast(pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), flat),
                    ],
                    ["doc_id", "text_key", "n_chars", "prefixes"],
                )

    schema = f"doc_id {kind}, text_key binary, n_chars long, prefixes array<binary>"
    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def _candidates(texts: DataFrame) -> DataFrame:
    """(node, component): texts that share a prefix with another one, directly or through others."""
    leaves = texts.select("text_key", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = (
        leaves.groupBy("tree", "prefix")
        .agg(F.min("text_key").alias("least"), F.max("text_key").alias("most"))
        .where("least <> most")
        .select("tree", "prefix", "least")
    )
    edges = leaves.join(shared, ["tree", "prefix"]).select("text_key", "least").where("text_key <> least").distinct()
    return connected_components(edges, "text_key", "least")


def _units(members: DataFrame) -> DataFrame:
    """Deal the texts of a component to units: each block with itself and with each other block."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("chars") / BLOCK_CHARS, F.lit(1))).cast("int")
    dealt = (
        members.join(sizes.select("component", blocks.alias("blocks")), "component")
        .withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select("text_key", "component", "block", low.alias("low"), high.alias("high"))


def _overlaps(owner: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """How many values each two of ``rows`` owners share; each owner holds a value once."""
    order = np.lexsort((owner, value))
    owner, value = owner[order], value[order]
    begins = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, int)
    holders = np.diff(np.append(begins, len(value)))
    shared = np.zeros((rows, rows), np.float32)
    common = np.flatnonzero(holders >= COMMON)
    for i in range(0, len(common), 1024):
        some = common[i : i + 1024]
        held = np.zeros((rows, len(some)), np.float32)
        for k, g in enumerate(some):
            held[owner[begins[g] : begins[g] + holders[g]], k] = 1
        shared += held @ held.T
    rare = np.repeat((holders > 1) & (holders < COMMON), holders)
    group = np.repeat(np.arange(len(begins)), holders)[rare]
    owner = owner[rare]
    flat = shared.ravel()
    for lag in range(1, COMMON - 1):
        same = group[lag:] == group[:-lag]
        if not same.any():
            break
        codes = owner[:-lag][same].astype(np.int64) * rows + owner[lag:][same]
        found, times = np.unique(codes, return_counts=True)
        flat[found] += times
        flat[found % rows * rows + found // rows] += times
    return shared


def linked(texts: pa.Array, width: int, threshold: float) -> np.ndarray:
    """Which texts have a Jaccard similarity of at least the threshold, exactly; a text not with itself."""
    values, begins = shingles.of_texts(texts, width)
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[first], values[first]
    size = np.bincount(owner, minlength=len(texts)).astype(np.float32)
    both = _overlaps(owner, values, len(texts))
    found = (both > 0) & (both >= np.float64(threshold) * (size[:, None] + size[None, :] - both) - 1e-6)
    np.fill_diagonal(found, False)
    return found


def _labels(links: np.ndarray) -> np.ndarray:
    """For each row the first row of its connected group."""
    label = np.arange(len(links))
    seen = np.zeros(len(links), bool)
    for i in range(len(links)):
        if seen[i]:
            continue
        front = np.zeros(len(links), bool)
        front[i] = True
        group = front.copy()
        while front.any():
            front = links[front].any(0) & ~group
            group |= front
        label[group], seen[group] = i, True
    return label


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _compare(width: int, threshold: float):
    """A unit's texts that have links there: how many, and the first text of the same group."""

    def compare(table: pa.Table) -> pa.Table:
        keys = pd.Series(table["text_key"].to_pylist())
        table = table.take(pa.array(np.flatnonzero(~keys.duplicated())))  # a row may be repeated
        keys = keys.drop_duplicates().to_numpy()
        links = linked(pa.concat_arrays([c.cast(pa.large_string()) for c in table["text"].chunks]), width, threshold)
        block = table["block"].to_numpy()
        labels = _labels(links)
        if table["low"][0].as_py() != table["high"][0].as_py():  # pairs inside a block have their own unit
            links = links & (block[:, None] != block[None, :])
        some = np.flatnonzero(links.any(1))
        names = ["text_key", "links", "root"]
        columns = [pa.array(keys[some], pa.binary()), pa.array(links.sum(1)[some], pa.int64())]
        return pa.Table.from_arrays([*columns, pa.array(keys[labels[some]], pa.binary())], names)

    return compare


def join(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    trees: int = 14,
    deepest: int = 6,
    recall: float = 0.999,
    keep_key: bool = False,
) -> DataFrame:
    """doc_id, text_id, class_id, copies and n_links for every row of ``docs``.

    ``text_id`` is the smallest doc_id with the same text, ``copies`` how many rows
    have that text, ``n_links`` how many other texts are at least ``threshold``
    similar, and ``class_id`` the smallest doc_id that can be reached over equal
    texts and links.  Null texts equal empty ones; texts without words are linked
    to none.  doc_id must be an integer; rows that repeat one are all returned.  No rows in,
    no rows out.  With ``keep_key`` the text's MD5 is returned as text_key: rows that share a doc_id can have different texts.
    """
    length = prefix_length(threshold, trees, deepest, recall)
    signed = settle(_signed(docs, width, trees, length))
    files = files_for(signed.count())  # no table of texts has more rows
    texts = settle(
        signed.groupBy("text_key").agg(
            F.min("doc_id").alias("text_id"),
            F.count("*").alias("copies"),
            F.any_value("n_chars").alias("n_chars"),
            F.any_value("prefixes").alias("prefixes"),
        ),
        files,
    )
    found = _candidates(texts)
    members = settle(
        found.withColumnRenamed("node", "text_key").join(texts.select("text_key", "text_id", "n_chars"), "text_key"), files
    )
    # the text of each member, read from the row that stands for it
    keyed = docs.select(
        F.col("doc_id").alias("text_id"), "text", F.unhex(F.md5(F.encode(_text(), "UTF-8"))).alias("text_key")
    )
    # one plan at every size: the members of each part are a hash table, the texts stream past it
    wanted = members.select("text_id", "text_key").hint("shuffle_hash")
    whole = keyed.join(wanted, ["text_id", "text_key"], "left_semi")
    links = settle(
        _units(members)
        .join(whole.select("text_key", "text"), "text_key")
        .groupBy("component", "low", "high")
        .applyInArrow(_compare(width, threshold), "text_key binary, links long, root binary")
    )
    counted = links.groupBy("text_key").agg(F.sum("links").alias("n_links"))
    groups = connected_components(links, "text_key", "root").withColumnRenamed("node", "text_key")
    grouped = (
        texts.select("text_key", "text_id", "copies")
        .join(counted, "text_key", "left")
        .join(groups, "text_key", "left")
        .withColumn("component", F.coalesce("component", "text_key"))
    )
    grouped = settle(grouped, files)
    named = grouped.groupBy("component").agg(F.min("text_id").alias("class_id"))
    per_text = grouped.join(named, "component").select(
        "text_key", "text_id", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    named_rows = signed.select("doc_id", "text_key").join(per_text, "text_key")
    return named_rows if keep_key else named_rows.drop("text_key")
