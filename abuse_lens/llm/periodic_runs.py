"""Periodic runs of words by online dyadic square catching (operator 12).

Words are read as one growing sequence.  Whenever a block of 2^k words is
complete (blocks begin at multiples of 2^k), a catcher of level k is set up for
it; it waits for squares whose halves have ``2^(k+1)-1 .. 2^(k+2)-2`` words,
because the first half of any such square holds one whole block.  An appended
word completes one suffix of 2^k words per level, and exactly two catchers of a
level are awake for it: a suffix equal to an awake catcher's block is a caught
repetition.  Catches of one period in neighbouring blocks merge, and what they
merge to is extended by at most a block on each side; it is a run if it is long
enough.  Of equal stretches the smallest period stays: the others are its
multiples (Fine and Wilf).

All words of a slice of texts are advanced together, level by level, so a level
costs a few array operations a word and a text of n words has log2(n) levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.llm.shingles import mix, slices

#: A run has this many words at least, and two periods.
LEAST_WORDS = 12
#: Text whose words are advanced at once; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
#: Between words (and nothing else is).
BLANKS = "\t\n\v\f\r "
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of every word of all texts in a row, the different words, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, begins


def _suffixes(words: np.ndarray) -> np.ndarray:
    return mix((words.astype(np.uint64) + np.uint64(1)) * _FACTOR)


def _double(level: np.ndarray, half: int) -> np.ndarray:
    """From numbers of all stretches of ``half`` words to those of twice as many."""
    return mix(level[:-half] * _FACTOR + np.roll(level, -half)[:-half])


def _extend(at: np.ndarray, period: np.ndarray, levels: list[np.ndarray], size: int, step: int) -> np.ndarray:
    """How far words equal those one period on, less than 2^len(levels), forwards from ``at`` or backwards before it."""
    far = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        begin = at + far if step > 0 else at - far - width
        inside = (begin >= 0) & (begin + period + width <= size)
        held = np.where(inside, begin, 0)
        with_period = np.where(inside, begin + period, 0)
        far += width * (inside & (levels[k][held] == levels[k][with_period]))
    return far


def _caught(level: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block begin, period) of every suffix that equals the block of an awake catcher of level ``k``."""
    width, least = 1 << k, (2 << k) - 1
    ends = np.arange(len(level))  # begin of the suffix that the appended word completes
    found = []
    for wait in (0, 1):  # the two catchers awake
        block = ((ends - least) >> k) - wait << k
        period = ends - block
        awake = (block >= 0) & (period <= 2 * least)
        hits = np.flatnonzero(awake & (level == level[np.maximum(block, 0)]))
        found.append((block[hits], period[hits]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of all runs, by begin and period, in one row of the words of several texts.

    ``begins`` has one entry more than there are texts.  No run reaches beyond its text.
    """
    counts = np.diff(begins)
    # a word of its own behind every text keeps texts apart
    apart = np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)
    row = np.empty(len(words) + len(counts), np.int64)
    row[apart] = words
    marks = begins[1:] + np.arange(len(counts))
    row[marks] = (int(words.max()) if len(words) else 0) + 1 + np.arange(len(counts))
    longest = int(counts.max()) if len(counts) else 0
    levels, parts = [_suffixes(row)], []
    for k in range(64):
        width, least = 1 << k, (2 << k) - 1
        if 2 * least > longest or len(levels[k]) <= least:
            break
        block, period = _caught(levels[k], k, len(row))
        if len(block):
            order = np.lexsort((block, period))
            block, period = block[order], period[order]
            new = np.ones(len(block), bool)
            new[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + width)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(block)) - 1
            each = period[first]
            # the neighbouring blocks were not caught, so less than a block is left on both sides
            begin = block[first] - _extend(block[first], each, levels[:k], len(row), -1)
            end = block[last] + width
            end = end + _extend(end, each, levels[:k], len(row), 1) + each
            long = end - begin >= np.maximum(LEAST_WORDS, 2 * each)
            parts.append((begin[long], end[long], each[long]))
        if 2 * width >= len(row):
            break
        levels.append(_double(levels[k], width))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    begin, end, period = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[new], end[new], period[new]
    # stretches were compared by number; the words themselves decide
    true = [np.array_equal(row[a : b - p], row[a + p : b]) for a, b, p in zip(begin, end, period, strict=True)]
    begin, end, period = (x[np.array(true, bool)] for x in (begin, end, period))
    text = np.searchsorted(marks, begin)
    begin, end = begin - text, end - text
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def _batch(texts: pa.Array, keep: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    words, different, begins = words_of(texts)
    begin, end, period = find_runs(words, begins)
    owner = np.searchsorted(begins, begin, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    members = [pa.array(begin - begins[owner]), pa.array(end - begin), pa.array(period)]
    runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(members, ["start", "length", "period"]))
    # a word goes if a run repeats it: cover of [begin + period, end)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, begin + period, 1)
    np.add.at(steps, end, -1)
    kept = np.cumsum(steps[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[begins]
    lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), different.take(pa.array(words[kept])))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    columns = [*keep.columns, pa.array(np.diff(begins)), runs, collapsed.cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, [*keep.schema.names, *names])


def collapse(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all others by default) with _words, _runs and _collapsed for every row.

    ``_words`` counts the words, runs of characters that are no ASCII blanks.
    ``_runs`` lists (start, length, period), by start and period: stretches
    of at least twelve words and two periods that repeat with their smallest
    period and that no neighbouring word prolongs.  ``_collapsed`` is the words joined by
    one blank, without those that a run repeats (each run keeps its first period).

    Null and empty texts have no words, no runs and an empty collapsed text.  Every row
    counts on its own, also repeated ones.  No rows in, no rows out.  Whole texts are
    read; a task holds some forty numbers for each word of a slice of texts, or of one long text.
    """
    others = [f for f in docs.schema.fields if f.name in (keep if keep is not None else set(docs.columns) - {text})]
    names = ["_words", "_runs", "_collapsed"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
            rest = batch.select([f.name for f in others])
            for a, b in slices(texts, SLICE_BYTES):
                yield _batch(texts.slice(a, b - a), rest.slice(a, b - a), names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    kinds += ["_words long", "_runs array<struct<start:long,length:long,period:long>>", "_collapsed string"]
    return docs.select(*[f"`{f.name}`" for f in others if f.name != text], f"`{text}`").mapInArrow(found, ", ".join(kinds))


def longest(runs: Column) -> Column:
    """The longest run, of equals the first, of these the one of the smallest period; null if there is none."""
    better = lambda a, b: F.when(a.isNull() | (b.length > a.length), b).otherwise(a)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, better)
