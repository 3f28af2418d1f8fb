"""Word shingles of texts as 64-bit numbers, and MinHash over them, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads near ones apart (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if len(sizes):
        yield begin, len(sizes)


def of_texts(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts in a row (repeated ones are kept), and where each text's begin.

    Words are runs of letters and digits in lower case.  A text of fewer than
    ``width`` words has one shingle of all of them, one without words has none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " "), " ")
    lists = pc.split_pattern(clean, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names.astype(object), categorize=False).astype(np.uint64) | np.uint64(1)
    hashes[names == ""] = 0  # the one piece of a text without words
    words = hashes[coded.indices.to_numpy()]
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(words))
    rolled = np.zeros(len(words), np.uint64)
    for k in range(width):
        shifted = np.zeros(len(words), np.uint64)
        shifted[: max(0, len(words) - k)] = words[k:]
        shifted[at + k >= ends] = 0
        rolled = rolled * _BASE + shifted
    first = np.zeros(len(words), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    valid = ((at + width <= ends) | first) & (words != 0)
    counts = np.concatenate([[0], np.cumsum(valid)])
    return mix(rolled[valid]), counts[offsets]


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _BASE)
    return (numbers[:count] | np.uint64(1)).astype(np.uint32), numbers[count:].astype(np.uint32)


def minhash(shingles: np.ndarray, begins: np.ndarray, count: int) -> np.ndarray:
    """One row of ``count`` 32-bit minima for each text that has shingles, in order."""
    sizes = np.diff(begins)
    starts = begins[:-1][sizes > 0]
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    factor, offset = seeds(count)
    rows = np.empty((len(starts), count), np.uint32)
    for k in range(count):
        x = (low ^ offset[k]) * factor[k]
        x ^= (x >> np.uint32(15)) ^ high
        x *= np.uint32(0x2C1B3C6D)
        rows[:, k] = np.minimum.reduceat(x ^ (x >> np.uint32(12)), starts) if len(starts) else 0
    return rows
