"""Byte-level BPE encoding and decoding (operator 1).

Merging is a fold of Spark's higher-order functions: a word's bytes are an array,
and every step joins the neighbours whose joined bytes have the lowest rank in a
literal rank map, until no neighbours have one.  A piece is a number that holds its
id and the rank it would make with the next piece, so a step looks up only the
two ranks that its merge changes.  The map is one literal row, a scalar subquery:
tasks get it as bytes, and no plan's text spells it out.

Words repeat, so the most frequent different words of all texts are folded once
and their ids go to every task as a table of bounded size.  A text then is a row
of known ids with few gaps; the words in the gaps are folded where they stand.
Texts are never shuffled, and a word's frequency decides only where it is folded.
Decoding looks the ids' bytes up in an array and concatenates them, many texts at a time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abuse_lens.llm.common import let
from abuse_lens.plans.settle import files_for, settle

#: An id takes so many bits of a piece's number, and its place in the word so many above them; its rank is on top.
ID_BITS, PLACE_BITS = 18, 26
#: No id: what stands before the first piece and behind the last.
NO_ID = (1 << ID_BITS) - 1
RANK_AT = ID_BITS + PLACE_BITS
NO_RANK = 1 << (ID_BITS + RANK_AT)
#: The rank map has a shard for every id, and a pair's shard is a sum of its ids; there its left id alone tells it.
SHARDS, SPREAD = 1 << ID_BITS, 4099
#: Words folded once for all texts, and their longest size: together the bound of the table that every task holds.
TABLE_WORDS, TABLE_BYTES = 500_000, 64
#: The fold's cost grows with the square of a word's size; beyond this many bytes a heap does the merging.
FOLD_BYTES = 256


@dataclass(frozen=True)
class Vocabulary:
    """A rank file's contents and the pattern that cuts text into words."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)

    def rank_map(self, spark: SparkSession) -> DataFrame:
        """One row: the ids of the 256 bytes, and a map in shards from the left id of two pieces to their joint rank."""
        if max(self.ranks.values(), default=0) >= NO_ID:
            raise ValueError(f"ranks must be below {NO_ID}")
        shards: list[list[tuple[int, int]]] = [[] for _ in range(SHARDS)]
        for raw, rank in self.ranks.items():
            for i in range(1, len(raw)):
                left, right = self.ranks.get(raw[:i]), self.ranks.get(raw[i:])
                if left is not None and right is not None:
                    shards[(left * SPREAD + right) % SHARDS].append((left, rank << RANK_AT))
        octets = [self.ranks[bytes([i])] for i in range(256)]
        return _one_row(spark, octets=(octets, pa.int64()), ranks=(shards, pa.map_(pa.int64(), pa.int64())))

    def pieces(self) -> list[bytes | None]:
        """Each id's bytes."""
        table: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for raw, rank in self.ranks.items():
            table[rank] = raw
        return table


def _one_row(spark: SparkSession, **arrays: tuple[list, pa.DataType]) -> DataFrame:
    return spark.createDataFrame(pa.table({name: pa.array([v], pa.list_(kind)) for name, (v, kind) in arrays.items()}))


def beside(df: DataFrame, row: DataFrame, name: str, body: Callable[[Column], Column]) -> DataFrame:
    """``df`` with a column made of its own columns and of the fields of ``row``, which is one literal row."""
    # used once, so that it becomes a part of the expression and no column of every row
    kept = df.select("*", row.select(F.struct("*").alias("row")).scalar().alias("_row"))
    return kept.select(*df.columns, let(F.col("_row"), body).alias(name))


def fold(word: Column, table: Column) -> Column:
    """array<int>: the ids of a word, by ranked merges over its bytes; ``table`` is the row of ``rank_map``."""

    def number(value: int) -> Column:
        return F.lit(value).cast("bigint")

    def rank(left: Column, right: Column) -> Column:
        shard = table["ranks"][(left * number(SPREAD) + right).bitwiseAND(number(SHARDS - 1))]
        return F.coalesce(F.element_at(shard, left), number(NO_RANK))

    def id_of(piece: Column) -> Column:
        return piece.bitwiseAND(number(NO_ID))

    def below_rank(piece: Column) -> Column:
        return piece.bitwiseAND(number((1 << RANK_AT) - 1))

    def merged(pieces: Column, least: Column, left: Column, at: Column) -> Column:
        joined = F.shiftright(least, RANK_AT)  # bytes are joined to the piece that has their rank
        place = least.bitwiseAND(number((1 << RANK_AT) - 1 - NO_ID))
        return F.transform(
            F.array_remove(pieces, pieces[at + 1]),
            lambda p: F.when(p == least, rank(joined, id_of(pieces[at + 2])) + place + joined)
            .when(p == left, rank(id_of(left), joined) + below_rank(left))
            .otherwise(p),
        )

    def step(pieces: Column, _: Column) -> Column:
        # places differ and grow, so the least number is the leftmost of the lowest rank
        def join(least: Column) -> Column:
            at = F.array_position(pieces, least).cast("int") - 1
            found = let(at, lambda at: let(pieces[at - 1], lambda left: merged(pieces, least, left, at)))
            return F.when(least < number(NO_RANK), found).otherwise(pieces)

        return let(F.array_min(pieces), join)

    # one character a byte
    octets = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    ids = F.transform(octets, lambda c: table["octets"][F.ascii(c)])
    none = F.array(number(NO_ID))
    start = let(
        F.concat(none, ids, none),
        lambda ids: F.transform(
            ids,
            lambda x, i: rank(x, F.coalesce(F.get(ids, i + 1), number(NO_ID))) + F.shiftleft(i.cast("bigint"), ID_BITS) + x,
        ),
    )
    found = let(
        start,
        lambda pieces: F.aggregate(
            F.slice(pieces, 4, F.size(pieces)), pieces, step,
            lambda last: F.transform(F.slice(last, F.lit(2), F.size(last) - 2), lambda p: id_of(p).cast("int")),
        ),
    )
    return F.when(word == "", F.array().cast("array<int>")).otherwise(found)


def merge_with_heap(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a very long word, in time that grows little faster than its size."""
    n = len(raw)
    piece = [raw[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i] + piece[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i] if piece[i] else n
        if j >= n or len(piece[i]) + len(piece[j]) != size or ranks.get(piece[i] + piece[j]) != rank:
            continue  # one of the two has been merged meanwhile
        piece[i], piece[j] = piece[i] + piece[j], b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if left >= 0 and right < n and (r := ranks.get(piece[left] + piece[right])) is not None:
                heapq.heappush(heap, (r, left, len(piece[left]) + len(piece[right])))
    return [ranks[p] for p in piece if p]


def words_of(text: Column, pattern: str) -> Column:
    """array<string>: the matches of the pattern, with Unicode classes, white space included."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def frequent_words(docs: DataFrame, pattern: str, count: int = TABLE_WORDS) -> DataFrame:
    """The ``count`` most frequent words of all texts, of at most ``TABLE_BYTES`` bytes each."""
    counts = docs.select(F.explode(words_of(F.col("text"), pattern)).alias("word")).groupBy("word")
    short = counts.agg(F.count("*").alias("n")).where(F.octet_length("word") <= TABLE_BYTES)
    return short.orderBy(F.desc("n"), "word").limit(count).select("word")


@lru_cache(maxsize=1)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


class _Table:
    """Known words and their ids, as a task holds them: arrays in the order of the words' hashes."""

    def __init__(self, words: pa.Array, ids: pa.Array) -> None:
        hashes = _hashes(words.to_numpy(zero_copy_only=False))
        order = np.argsort(hashes, kind="stable")
        ids = ids.take(pa.array(order))
        self.words, self.hashes = words.take(pa.array(order)), hashes[order]
        self.flat = ids.values.to_numpy().astype(np.int32)
        self.begins = ids.offsets.to_numpy().astype(np.int64)

    def places(self, names: pa.Array) -> np.ndarray:
        """Where each name is, or -1; of words with one hash only the first is found."""
        found = np.searchsorted(self.hashes, _hashes(names.to_numpy(zero_copy_only=False)))
        found[found == len(self.hashes)] = 0
        if not len(self.hashes) or not len(names):
            return np.full(len(names), -1)
        same = pc.equal(self.words.take(pa.array(found)), names.cast(self.words.type))
        return np.where(same.to_numpy(zero_copy_only=False), found, -1)


def _hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words.astype(object), categorize=False)


def _segments(words: pa.Array, table: _Table, ranks: dict[bytes, int]) -> tuple[pa.Array, pa.Array]:
    """For each list of words: rows of ids of known words, and the words between these rows."""
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    names = coded.dictionary
    known = table.places(names)
    begins, flat = table.begins, table.flat
    # very long words are merged here
    long = pc.greater(pc.binary_length(names), FOLD_BYTES).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero((known < 0) & long):
        flat = np.concatenate([flat, np.array(merge_with_heap(names[i].as_py().encode(), ranks), np.int32)])
        known[i] = len(begins) - 1
        begins = np.append(begins, len(flat))
    codes = coded.indices.to_numpy()
    places = known[codes]
    gap = places < 0
    safe = np.where(gap, 0, places)
    sizes = np.where(gap, 0, begins[safe + 1] - begins[safe]) if len(begins) > 1 else np.zeros(len(safe), np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ids = flat[np.repeat(begins[safe] - ends[:-1], sizes) + np.arange(ends[-1])] if len(safe) else flat[:0]
    # a row ends at a gap and at the end of a text
    gaps = np.flatnonzero(gap)
    cuts = np.sort(np.concatenate([gaps, offsets[1:]]), kind="stable")
    before = np.searchsorted(gaps, offsets)  # gaps before each text
    rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[cuts]]), pa.int32()), pa.array(ids, pa.int32()))
    rows = pa.ListArray.from_arrays(pa.array(before + np.arange(len(offsets)), pa.int32()), rows)
    missing = coded.dictionary.take(pa.array(codes[gaps]))
    return rows, pa.ListArray.from_arrays(pa.array(before, pa.int32()), missing)


def encode(docs: DataFrame, vocabulary: Vocabulary, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text, as the tiktoken library encodes it.

    Without special tokens; null and empty texts have no ids; repeated rows are encoded
    each on their own; further columns are ignored.
    """
    spark = docs.sparkSession
    ranks = vocabulary.rank_map(spark)
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = settle(frequent_words(plain, vocabulary.pattern, table_words))
    dealt = words.repartition(64, "word")  # few words, but each takes a while
    folded = beside(dealt, ranks, "ids", lambda table: fold(F.col("word"), table))
    known = settle(folded.repartition(files_for(table_words))).toArrow().combine_chunks()

    def one(name: str, kind: pa.DataType) -> pa.Array:
        return pa.concat_arrays([c.cast(kind) for c in known[name].chunks] or [pa.array([], kind)])

    table = spark.sparkContext.broadcast(_Table(one("word", pa.large_string()), one("ids", pa.large_list(pa.int32()))))
    rules = spark.sparkContext.broadcast(vocabulary)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                words, odd = (batch.column(c).slice(a, 1000) for c in ("words", "odd"))
                if odd.null_count < len(odd):
                    find = _compiled(rules.value.pattern).findall
                    pairs = zip(words.to_pylist(), odd.to_pylist(), strict=True)
                    words = pa.array([w if t is None else find(t) for w, t in pairs], words.type)
                rows, missing = _segments(words, table.value, rules.value.ranks)
                arrays = [batch.column("doc_id").slice(a, 1000), rows, missing.cast(pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "rows", "missing"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # code points that Java does not know yet may be letters to the library
    odd = F.when(F.col("text").rlike(r"\p{Cn}"), F.col("text"))
    cut = plain.select("doc_id", words_of(F.col("text"), vocabulary.pattern).alias("words"), odd.alias("odd"))
    parts = cut.mapInArrow(segment, f"doc_id {kind}, rows array<array<int>>, missing array<string>")
    none = F.array(F.array().cast("array<int>"))

    def strung(table: Column) -> Column:
        folded = F.transform("missing", lambda w: fold(w, table))
        return F.flatten(F.zip_with("rows", F.concat(folded, none), lambda known, gap: F.concat(known, gap)))

    return beside(parts, ranks, "ids", strung).select("doc_id", "ids")


def decode(ids: pa.ListArray, pieces: pa.LargeBinaryArray) -> list[bytes | None]:
    """The bytes of each list of ids, piece by piece; an id that ``pieces`` lacks makes the result null."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
    found = pieces.take(pc.if_else(inside, flat, None))
    lacking = np.concatenate([[0], np.cumsum(found.is_null().to_numpy(zero_copy_only=False))])[offsets]
    joined = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pc.fill_null(found, b""))
    texts = pc.binary_join(joined, pa.scalar(b"", pa.large_binary())).to_pylist()
    return [t if a == b else None for t, a, b in zip(texts, lacking[:-1], lacking[1:], strict=True)]


def little_endian(ids: pa.ListArray) -> list[bytes]:
    """Each list of ids as unsigned 32-bit integers, lowest byte first."""
    offsets = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
    return [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to."""
    found = encode(docs, vocabulary)
    table = docs.sparkSession.sparkContext.broadcast(vocabulary.pieces())

    def digest(raw: bytes | None) -> str | None:
        return None if raw is None else hashlib.sha256(raw).hexdigest()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(table.value, pa.large_binary())
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                doc_id, ids = (batch.column(c).slice(a, 1000) for c in ("doc_id", "ids"))
                of_ids = pa.array(map(digest, little_endian(ids)), pa.string())
                of_bytes = pa.array(map(digest, decode(ids, pieces)), pa.string())
                sizes = pc.list_value_length(ids).cast(pa.int64())
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([doc_id, sizes, of_ids, of_bytes], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(digests, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
