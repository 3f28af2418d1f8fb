"""Best-fit packing by bin completion (operator 7).

Only lengths matter to a packing, and there are at most ``capacity`` of them.
So the search runs over the histogram of lengths: a bin is completed around the
largest length left, with fillings that no other filling dominates, and the
same filling is used as many times as the counts allow.  The answer is a short
table of fillings, each used many times, from which every piece finds its
sequence and place by its rank among the pieces of its length.  Texts, ids and
pieces never leave the executors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abuse_lens.plans.settle import settle

SLICE_BYTES = 4_000_000
MEMO_CHUNKS = 1_000_000
SENTINEL = "\ue000"
#: Lower and upper case of these are one letter each, in any normal form.
PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Steps of branch and bound, and patterns made while wasteful bins are completed anew, before the search settles for the best packing so far.
SEARCH_NODES, REPAIR_STEPS = 5000, 20_000
#: A length's pieces are numbered in so many parts, so that a common length is no single task.
PARTS = 512


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=2)
def _word_encoding(path: str):
    """A fast encoder of plain words, for a tokenizer that is byte-level with a mark at a word's end; else None.

    The word's end is written as a zero byte, so the tokenizer's merges become
    ranks of byte strings.  Both give the same ids because every token of the
    vocabulary, encoded alone, is itself.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    mark = model.get("end_of_word_suffix")
    byte = {c: b for b, c in _byte_characters().items()}
    if not mark or any(f"{c}{mark}" not in model["vocab"] for c in byte):
        return None
    ranks, ends = {}, np.zeros(max(model["vocab"].values()) + 1, bool)
    for token, rank in model["vocab"].items():
        body = token.removesuffix(mark)
        if all(c in byte for c in body):
            raw = bytes(byte[c] for c in body)
            ranks.setdefault(raw + bytes(1) * (body != token), rank)
            ends[rank] = body != token
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ends


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Chunks:
    """Ids of chunks of text between blanks, each chunk encoded once.

    No word of the tokenizer holds white space, so a text's ids are those of its
    chunks in order.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.words = _tokenizer(path), _word_encoding(path)
        self.mark = self._encode(SENTINEL)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, chunks: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        begin = len(self.place)
        self.place.update(zip(chunks, range(begin, begin + len(chunks)), strict=True))
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        for name, values in {"starts": starts, "lengths": lengths, "flat": ids}.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these entries in a row, and where each entry ends."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[places] - (ends - lengths), lengths) + np.arange(total)], ends

    def _add_words(self, words: list[str]) -> None:
        """Words of letters only, in one call."""
        if words:
            encoding, ends = self.words
            ids = encoding.encode_to_numpy("\0".join([*words, ""]).lower(), disallowed_special=())
            self._add(words, np.diff(np.flatnonzero(ends[ids]), prepend=-1), ids)

    def _add_others(self, words: list[str]) -> None:
        """Other short strings in few calls: joined by a mark that none of them has."""
        odd = [w for w in words if SENTINEL in w]
        plain = [w for w in words if SENTINEL not in w]
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            ids = self._encode(f" {SENTINEL} ".join([*some, ""]))
            hits = ids == self.mark[0]
            for k, m in enumerate(self.mark[1:], 1):
                hits[: len(ids) - k] &= ids[k:] == m
            ends = np.flatnonzero(hits)
            marks = np.zeros(len(ids), bool)
            for k in range(len(self.mark)):
                marks[ends + k] = True
            lengths = np.diff(ends, prepend=-len(self.mark)) - len(self.mark)
            self._add(some, lengths, ids[~marks])
        for word in odd:
            ids = self._encode(word)
            self._add([word], np.array([len(ids)]), ids)

    def places(self, chunks: list[str]) -> np.ndarray:
        if len(self.place) > MEMO_CHUNKS:
            self.clear()
        place = self.place
        new = [c for c in chunks if c not in place]
        # a word and the full stop behind it are two words to the tokenizer
        bodies, tails, parted, whole = [], [], [], {}
        for chunk in new:
            body = chunk.rstrip(".,!?;:")
            if body and len(body) < len(chunk) and body[-1].lower()[-1].isalnum():
                parted.append(chunk)
                bodies.append(body)
                tails.append(chunk[len(body) :])
            else:
                whole[chunk] = None
        for word in (*bodies, *set(tails)):
            if word not in place:
                whole[word] = None
        simple = PLAIN_WORD.fullmatch if self.words else lambda _: None
        fast = [w for w in whole if simple(w)]
        self._add_words(fast)
        known = set(fast)
        self._add_others([w for w in whole if w not in known])
        if parted:
            both = np.stack([_array(place, bodies), _array(place, tails)], 1).ravel()
            ids, ends = self.ids(both)
            self._add(parted, np.diff(ends[1::2], prepend=0), ids)
        return _array(place, chunks)


def _array(place: dict[str, int], keys: list[str]) -> np.ndarray:
    return np.fromiter(map(place.__getitem__, keys), np.int64, len(keys))


@lru_cache(maxsize=1)
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE_BYTES:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if len(sizes):
        yield begin, len(sizes)


def encode_texts(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of every text in order, by the tokenizer file at ``path``."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    store = _chunks(path)
    for a, b in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
        lists = pc.split_pattern(pc.replace_substring(texts.slice(a, b - a), "\n", " "), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        ids, ends = store.ids(store.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()])
        before = np.concatenate([[0], ends])[offsets - offsets[0]]
        for i in range(b - a):
            yield ids[before[i] : before[i + 1]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row's whole text.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are
    cut.  A null text is empty and so has one piece of length 1.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut(batch)
        _chunks(tokenizer).clear()  # the worker goes on to other tasks, which need the memory
        pa.default_memory_pool().release_unused()

    def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        doc_ids = batch.column("doc_id").to_pylist()
        for doc_id, ids in zip(doc_ids, encode_texts(batch.column("text"), tokenizer), strict=True):
            ids = np.append(ids, end_id).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class _Search:
    """Bin completion over a histogram of lengths.

    A bin holds the largest length left and a filling of the rest of the bin.
    A whole packing comes first: each filling is completed by the pair that wastes
    least, among equal ones by a draw that favours common lengths, so that no
    length runs out early.  Then the bins that waste are opened together with
    some full ones and completed anew, as long as that takes no more bins.  What
    is still above the bound by the sum of lengths is searched by branch and
    bound: every filling that none dominates is a branch of every node, and a
    branch is cut when its bins, with the least waste of what is left, are as
    many as the best packing has.  All draws are seeded: equal histograms are packed alike.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.counts = capacity, np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.counts[length] = n
        self.total = int((self.counts * np.arange(capacity + 1)).sum())
        # no packing has fewer bins: by the sum of lengths, and because k pieces at most fit a bin if all are longer than a (k+1)-th of it
        self.least = -(-self.total // capacity)
        longer = int(self.counts.sum()) - np.cumsum(self.counts)  # pieces above each length
        k = np.arange(1, capacity + 1)
        self.least = max(self.least, int((-(-longer[capacity // (k + 1)] // k)).max()))
        self.random, self.steps = np.random.default_rng(0), 0

    def _filling(self, counts: np.ndarray, gap: int) -> list[int]:
        """Pieces for ``gap``, taken from ``counts``, two at a time."""
        filling: list[int] = []
        while gap:
            firsts = np.flatnonzero(counts[: gap + 1])
            if not len(firsts):
                break
            longest = int(firsts[-1])
            if gap >= 16 * longest:  # many short pieces go in at once
                times = min(int(counts[longest]), gap // (2 * longest))
                filling += [longest] * times
                counts[longest] -= times
                gap -= longest * times
                continue
            at = np.searchsorted(firsts, gap - firsts, side="right") - 1
            # a second piece like the first needs two of them
            at -= (at == np.arange(len(firsts))) & (counts[firsts] < 2)
            seconds = np.where(at >= 0, firsts[np.maximum(at, 0)], 0)
            waste = gap - firsts - seconds
            ties = np.flatnonzero(waste == waste.min())
            common = counts[firsts[ties]] * np.where(seconds[ties] > 0, counts[seconds[ties]], 1).astype(float)
            i = ties[np.argmax(common * self.random.random(len(ties)))]
            for x in (int(firsts[i]), int(seconds[i])):
                if x:
                    filling.append(x)
                    counts[x] -= 1
                    gap -= x
        return filling

    def _complete(self, counts: np.ndarray) -> dict[tuple[int, ...], int]:
        """A packing of all of ``counts``: how often each pattern is used."""
        counts, used = counts.copy(), {}
        while len(left := np.flatnonzero(counts)):
            largest = int(left[-1])
            counts[largest] -= 1
            pattern = (largest, *self._filling(counts, self.capacity - largest))
            lengths, each = np.unique(pattern, return_counts=True)
            more = int((counts[lengths] // each).min())
            counts[lengths] -= each * more
            used[pattern] = used.get(pattern, 0) + more + 1
            self.steps += 1 + len(pattern) // 16
        return used

    def _repair(self, used: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], int]:
        """Open the bins that waste and about twice as many full ones, and complete them anew."""
        patterns = list(used)
        times = np.array([used[p] for p in patterns])
        wastes = np.array([sum(p) < self.capacity for p in patterns])
        share = min(1.0, 2 * max(times[wastes].sum(), 20) / max(times[~wastes].sum(), 1))
        opened = np.where(wastes, times, self.random.binomial(times, share))
        freed = np.zeros(self.capacity + 1, np.int64)
        for pattern, n in zip(patterns, opened, strict=True):
            np.add.at(freed, list(pattern), n)
        found = self._complete(freed)
        if sum(found.values()) > opened.sum():
            return used
        kept = {p: int(t - n) for p, t, n in zip(patterns, times, opened, strict=True) if t > n}
        for pattern, n in found.items():
            kept[pattern] = kept.get(pattern, 0) + n
        return kept

    def _fit(self, counts: np.ndarray, gap: int) -> int:
        """The largest length left that fits, 0 if none does."""
        some = np.flatnonzero(counts[1 : gap + 1])
        return int(some[-1]) + 1 if len(some) else 0

    def _fillings(self, counts: np.ndarray, gap: int, most: int) -> Iterator[tuple[int, ...] | None]:
        """Every filling of ``gap`` by pieces of at most ``most`` to which nothing can be added, larger pieces first.

        A length is taken as often as it can be, then once less each time, so the depth is the number of different lengths.
        None stands for a choice to which something can still be added.
        """
        chosen: list[list[int]] = []
        x = self._fit(counts, min(gap, most))
        while True:
            while x:
                times = min(int(counts[x]), gap // x)
                chosen.append([x, times])
                gap -= x * times
                x = self._fit(counts, min(gap, x - 1))
            used = {length: times for length, times in chosen}
            more = self._fit(counts, gap)
            while more and used.get(more) == counts[more]:
                more = self._fit(counts, more - 1)
            yield None if more else tuple(length for length, times in chosen for _ in range(times))
            while chosen and not x:
                length, times = chosen[-1]
                gap += length
                if times > 1:
                    chosen[-1][1] -= 1
                else:
                    chosen.pop()
                x = self._fit(counts, min(gap, length - 1))
                if not x and times > 1:
                    break
            if not x and not chosen:
                return

    def _dominated(self, counts: np.ndarray, filling: tuple[int, ...], waste: int) -> bool:
        """Whether a piece left could take the place of a smaller one, or of two, within the bin."""
        pieces, each = np.unique(filling, return_counts=True)
        pairs = {int(a + b) for i, a in enumerate(pieces) for b in pieces[: i + (each[i] > 1)]}
        return any(self._fit(counts, int(x) + waste) > x for x in pieces) or any(self._fit(counts, x + waste) >= x for x in pairs)

    def _branches(self, counts: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
        """Undominated fillings around the largest length, each as often as it can be and once; 0 times marks a dominated one."""
        largest = int(np.flatnonzero(counts)[-1])
        left = counts.copy()
        left[largest] -= 1
        for filling in self._fillings(left, self.capacity - largest, self.capacity):
            if filling is None:
                yield (largest,), 0
                continue
            pattern = (largest, *filling)
            lengths, each = np.unique(pattern, return_counts=True)
            after = counts.copy()
            after[lengths] -= each
            if self._dominated(after, filling, self.capacity - sum(pattern)):
                yield pattern, 0
                continue
            times = int((counts[lengths] // each).min())
            yield pattern, times
            if times > 1:
                yield pattern, 1

    def _branch_and_bound(self, bins_best: int) -> list[tuple[tuple[int, ...], int]] | None:
        """A packing with fewer bins than ``bins_best``, the best within the budget of nodes; None if none is found."""
        best, nodes = None, 0
        used: list[tuple[tuple[int, ...], int]] = []
        counts, left, bins = self.counts.copy(), self.total, 0
        open_nodes = [self._branches(counts.copy())]
        while open_nodes and nodes < SEARCH_NODES and bins_best > self.least:
            nodes += 1
            branch = next(open_nodes[-1], None)
            if branch is None:
                open_nodes.pop()
                if used:
                    pattern, times = used.pop()
                    np.add.at(counts, list(pattern), times)
                    left, bins = left + sum(pattern) * times, bins - times
                continue
            pattern, times = branch
            rest = left - sum(pattern) * times
            # the waste so far and no more from here on
            if not times or bins + times + -(-rest // self.capacity) >= bins_best:
                continue
            if not rest:
                best, bins_best = [*used, branch], bins + times
                continue
            used.append(branch)
            np.subtract.at(counts, list(pattern), times)
            left, bins = rest, bins + times
            open_nodes.append(self._branches(counts.copy()))
        return best

    def run(self) -> list[tuple[tuple[int, ...], int]]:
        used = self._complete(self.counts)
        first = self.steps
        while sum(used.values()) > self.least and self.steps < first + REPAIR_STEPS:
            used = self._repair(used)
        bins = sum(used.values())
        return (bins > self.least and self._branch_and_bound(bins)) or list(used.items())


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences), covering every piece once."""
    full = counts.get(capacity, 0)
    rest = {n: c for n, c in counts.items() if n != capacity and c}
    found = [((capacity,), full)] if full else []
    return found + (_Search(rest, capacity).run() if rest else [])


def slots(planned: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For runs of ranks of a length: first_rank, each (per sequence), first sequence, first offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in planned:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            first = taken.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            taken[length] = first + each * times
            offset += each * length
        sequence += times
    table = pd.DataFrame(rows, columns=["length", "first_rank", "each", "sequence", "offset"], dtype="int64")
    return table.sort_values(["length", "first_rank"], ignore_index=True)


def _ranked(parts: DataFrame) -> DataFrame:
    """``rank``: 0, 1, ... among the pieces of a length, numbered in parts."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS))
    cut = parts.withColumn("part", part)
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select("length", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    numbered = cut.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece with its ``sequence_id`` (from 0) and ``offset`` there.

    Sequences hold at most ``capacity`` tokens and have no gaps.  Repeated rows are
    packed each on their own.  No rows in, no rows out.  The histogram has at most
    ``capacity`` entries and the table of slots a few for each and for each step
    of the search, whatever the input; only these are on the driver and broadcast.
    """
    parts = settle(pieces(docs, tokenizer, capacity, end_id))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    columns = {c: table[c].to_numpy() for c in table.columns}
    shared = parts.sparkSession.sparkContext.broadcast(columns)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        begin = np.searchsorted(s["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch.pop("rank").to_numpy(np.int64)
            at = np.empty(len(batch), np.int64)
            for n in np.unique(length):
                mine, a, b = length == n, begin[n], begin[n + 1]
                at[mine] = a + np.searchsorted(s["first_rank"][a:b], rank[mine], side="right") - 1
            nth = rank - s["first_rank"][at]
            batch["sequence_id"] = s["sequence"][at] + nth // s["each"][at]
            batch["offset"] = s["offset"][at] + nth % s["each"][at] * length
            yield batch

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = _ranked(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(place, schema)
