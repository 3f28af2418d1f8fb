"""Removal of repeated byte strings with suffix arrays grouped by Lyndon prefixes (operator 11).

A byte string of ``size`` bytes that starts at two places must meet itself in one task.  So
every window of ``size`` bytes is dealt by its anchor: the least of the hashes of the
``size // 3``-byte grams (two bytes at least) in it, which is the same wherever the window stands.
Neighbouring windows with one anchor are a piece.  Pieces whose anchor is nowhere else repeat nothing and go no further;
equal pieces are counted and one of them goes on.  The bytes of the pieces left, which are few next to the
corpus, are dealt to buckets by anchor, and a bucket's windows are compared with its suffix array.

The suffix array is over words (any cut that bytes inside a window decide will do), so it is several times
shorter than the bytes; a window is found by the first word that begins in it: right of that word the suffix array's neighbours
share enough bytes, left of it a few bytes must be equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.llm.common import let
from abuse_lens.llm.shingles import mix
from abuse_lens.plans.settle import settle

#: Windows that a task hashes at once; longer texts are read in overlapping parts.  Positions there take 20 bits of a number.
SLICE_WINDOWS = 200_000
#: Pieces in a bucket, on average, and the most that may share an anchor there; more are split into single windows.
BUCKET_PIECES, GROUP_PIECES = 4096, 8192
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOW = np.uint64((1 << 20) - 1)
WHERE = ["_id", "_row"]
_LETTERS = np.isin(np.arange(256), [*b"0123456789", *range(65, 91), *range(97, 123), *range(128, 256)])
#: Words of the suffix array begin with one letter in four, so they are mostly several of the text's.
_BEGINS = _LETTERS & (np.arange(256) % 4 == 0)


# --- suffix arrays ---


def suffix_array(symbols: list[int]) -> list[int]:
    """The begins of all suffixes in order; the last symbol must be the only least one.

    Suffixes with one Lyndon prefix form a group, and groups have an order.  At first a group is
    a symbol.  From the highest group down, every suffix of a group looks for the nearest
    suffix before it in a lower group, its previous smaller one: that suffix's Lyndon prefix
    goes on with the group's, once for each member that points to it, so it moves up within its group.
    When all groups are final, each suffix in order, the least first, fixes the place of those
    before it whose next smaller suffix it is: they are the next of their groups.
    """
    n = len(symbols)
    array = np.asarray(symbols, np.int64)
    order = np.argsort(array, kind="stable")
    cuts = np.flatnonzero(np.diff(array[order], prepend=array[order[0]] - 1))
    first = np.empty(n, np.int64)
    first[order] = np.repeat(cuts, np.diff(np.append(cuts, n)))
    group: list[int] = first.tolist()  # of each suffix: where its group begins in the order
    by_group = {int(a): part.tolist() for a, part in zip(cuts, np.split(order, cuts[1:]), strict=True)}
    begin_of = {int(b): int(a) for a, b in zip(cuts, np.append(cuts[1:], n), strict=True)}  # group end -> group begin
    end_of = {a: b for b, a in begin_of.items()}
    smaller = [-1] * n
    end = n
    while end > 0:
        low = begin_of[end]
        pointed: dict[int, int] = {}
        for i in by_group.pop(low):
            if group[i] != low:
                continue  # has moved up
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if len(pointed) == 1:
            ((j, times),) = pointed.items()
            moves = [((group[j], times), [j])]
        else:
            together: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                together.setdefault((group[j], times), []).append(j)
            moves = sorted(together.items(), reverse=True)
        for (old, _), members in moves:
            top = end_of[old]
            new = top - len(members)
            if new == old:
                by_group[old] = sorted(members)
                continue
            for j in members:
                group[j] = new
            by_group[new] = sorted(members)
            begin_of[top], end_of[new] = new, top
            begin_of[new], end_of[old] = old, new
        end = low
    result, free = [-1] * n, list(range(n))  # the next free place of the group that begins there
    result[0], placed = n - 1, bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = result[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return result


def _shared_prefixes(flat: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, size: int) -> np.ndarray:
    """How many bytes are equal from ``a`` and from ``b`` on, up to ``most`` and ``size``."""
    shared = np.zeros(len(a), np.int64)
    alive, done = np.arange(len(a)), 0
    while len(alive) and done < size:
        width = min(max(16, done), size - done)
        span = np.arange(done, done + width)
        whole = []
        for i in range(0, len(alive), 50_000):
            some = alive[i : i + 50_000]
            x, y = (np.minimum(v[some][:, None] + span, len(flat) - 1) for v in (a, b))
            differ = flat[x] != flat[y]
            equal = np.where(differ.any(1), differ.argmax(1), width)
            shared[some] = done + equal
            whole.append(equal == width)
        alive = alive[np.concatenate(whole) & (most[alive] > done + width)]
        done += width
    return np.minimum(shared, most)


def repeated_windows(pieces: pa.Array, at: np.ndarray, spans: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of all windows of ``size`` bytes that occur in the pieces more than once.

    A piece has ``spans + 1`` windows, one from each byte on; its anchor begins at byte ``at``, inside all of them.
    """
    pieces = pieces.cast(pa.large_binary())
    begins = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    flat = np.frombuffer(pieces.buffers()[2], np.uint8)[begins[0] : begins[-1]]
    begins = begins - begins[0]
    cut = np.zeros(len(flat) + 1, bool)
    cut[1:-1] = _BEGINS[flat[1:]] & ~_LETTERS[flat[:-1]]
    forced = begins[:-1] + at + 1  # inside every window, also in texts without blanks
    cut[forced] = True
    cut[begins] = True
    starts = np.flatnonzero(cut)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(flat)])
    coded = words.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    starts = starts[:-1]
    owner = np.searchsorted(begins, starts, side="right") - 1
    # 0 ends it all, 1 ends a piece, a word is two more than its rank
    row = np.ones(len(starts) + len(pieces) + 1, np.int64)
    place = np.arange(len(starts)) + owner
    row[place] = rank[coded.indices.to_numpy()] + 2
    row[-1] = 0
    word_at = np.full(len(row), -1, np.int64)
    word_at[place] = np.arange(len(starts))
    order = word_at[np.array(suffix_array(row.tolist()))]
    order = order[order >= 0]

    start, mine = starts[order], owner[order]
    room = begins[mine + 1] - start
    near = np.zeros(len(order) + 1, np.int64)  # bytes shared with the one before
    if len(order) > 1:
        near[1:-1] = _shared_prefixes(flat, start[:-1], start[1:], np.minimum(np.minimum(room[:-1], room[1:]), size), size)
    previous = np.where(start > begins[mine], np.append(-1, starts)[order], start)  # the word before, none at a piece's begin
    gap = start - previous
    left = np.zeros(len(order), np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    alive = np.flatnonzero(gap > 0)
    for t in range(1, int(gap.max(initial=0)) + 1):
        alive = alive[gap[alive] >= t]
        left[alive] = mix(left[alive] ^ _BYTES[flat[start[alive] - t]])
        joined = near >= size - t
        window = start[alive] - t - begins[mine[alive]]
        hits = alive[(joined[alive] | joined[alive + 1]) & (window <= spans[mine[alive]])]
        if not len(hits):
            continue
        segment = np.cumsum(~joined)[hits]
        by = np.lexsort((left[hits], segment))
        same = (np.diff(segment[by]) == 0) & (np.diff(left[hits][by].view(np.int64)) == 0)
        twice = np.zeros(len(hits), bool)
        twice[by[1:]] |= same
        twice[by[:-1]] |= same
        hits = hits[twice]
        found.append((mine[hits], start[hits] - t - begins[mine[hits]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# --- pieces ---


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


def pieces_of(flat: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """text, begin, windows, anchor's place in the piece, anchor and content (64-bit numbers) of every piece of all texts in a row."""
    gram, n = max(2, size // 3), len(flat)
    if n < size:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    back = _powers(pow(_BASE, -1, 1 << 64), n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[flat] * _powers(_BASE, n + 1)[:-1], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * back[: n + 1 - gram])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    wide, width = size - gram + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: width - wide], least[wide - width :])
    window = np.arange(len(least))
    text = np.searchsorted(begins, window, side="right") - 1
    inside = window + size <= begins[text + 1]
    window, text, anchor = window[inside], text[inside], (least[inside] & _LOW).astype(np.int64)
    if not len(window):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(text) != 0)))
    begin, end = window[new], window[np.append(new[1:], len(window)) - 1]
    anchor, text = anchor[new], text[new]
    shape = ((anchor - begin) * size + (end - begin)).astype(np.uint64)
    content = mix((sums[end + size] - sums[begin]) * back[begin]) ^ mix(shape + np.uint64(_BASE))
    return text, begin - begins[text], end - begin + 1, anchor - begin, grams[anchor].view(np.int64), content.view(np.int64)


def _parts(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, byte it begins at, bytes, begins) of parts whose windows together are all windows of all texts."""
    begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        if begins[i + 1] - begins[i] > SLICE_WINDOWS:
            for a in range(begins[i], begins[i + 1], SLICE_WINDOWS):
                b = min(a + SLICE_WINDOWS + size - 1, begins[i + 1])
                yield i, int(a - begins[i]), flat[a:b], np.array([0, b - a])
            i += 1
            continue
        j = max(int(np.searchsorted(begins, begins[i] + SLICE_WINDOWS, side="right")) - 1, i + 1)
        yield i, 0, flat[begins[i] : begins[j]], begins[i : j + 1] - begins[i]
        i = j


def _scan(rows: DataFrame, size: int, whole: bool) -> DataFrame:
    """Anchors and their numbers in a batch of texts, or whole pieces."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_bytes").cast(pa.large_binary())
            for first, shift, flat, begins in _parts(texts, size):
                text, begin, windows, at, anchor, content = pieces_of(flat, begins, size)
                if whole:
                    taken = batch.select(WHERE).take(pa.array(first + text))
                    columns = [*taken.columns, *map(pa.array, (begin + shift, windows, at, anchor, content))]
                    yield pa.RecordBatch.from_arrays(columns, [*WHERE, "begin", "windows", "at", "anchor", "content"])
                else:
                    found, times = np.unique(anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["anchor", "n"])

    if whole:
        return rows.select(*WHERE, "_bytes").mapInArrow(scan, "_id long, _row long, begin long, windows long, at long, anchor long, content long")
    return rows.select("_bytes").mapInArrow(scan, "anchor long, n long")


def _compare(size: int):
    """The repeated windows of a bucket's pieces that occur once each, as runs of bytes."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        windows, at, begin = (table[c].to_numpy() for c in ("windows", "at", "begin"))
        piece, window = repeated_windows(table["bytes"].chunk(0) if table["bytes"].num_chunks else pa.array([], pa.binary()), at, windows - 1, size)
        alone = table["n"].to_numpy()[piece] == 1  # of more frequent pieces all windows are repeated
        piece, window = piece[alone], window[alone]
        order = np.lexsort((window, piece))
        piece, window = piece[order], window[order]
        new = np.flatnonzero(np.append(True, (np.diff(window) != 1) | (np.diff(piece) != 0))) if len(piece) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(piece))[: len(new)] - 1
        where = table.select(WHERE).take(pa.array(piece[new]))
        ends = begin[piece[last]] + window[last] + size
        columns = [*where.columns, pa.array(begin[piece[new]] + window[new]), pa.array(ends)]
        return pa.Table.from_arrays(columns, [*WHERE, "begin", "end"])

    return compare


def _named(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the text's bytes in its place and two numbers that no other text of the doc_id has; equal rows share them."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    others = [c for c in docs.columns if c != text]
    return docs.select(ident.alias("_id"), F.xxhash64(F.col("doc_id").isNull(), raw).alias("_row"), *others, raw.alias("_bytes"))


def _with_bytes(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``wanted`` pieces, each once, with their bytes cut from the texts."""
    fields = ["begin", "windows", "at", "anchor", "n", "k"]
    of_row = wanted.groupBy(*WHERE).agg(F.collect_list(F.struct(*fields)).alias("pieces")).hint("shuffle_hash")

    def cut(raw: Column) -> Column:
        part = lambda p: F.substring(raw, (p.begin + 1).cast("int"), (p.windows + size - 1).cast("int"))
        return F.transform("pieces", lambda p: p.withField("bytes", part(p)))

    joined = rows.join(of_row, WHERE).select(*WHERE, "doc_id", let(F.col("_bytes"), cut).alias("pieces"))
    # a row may be repeated; it is where it is already, so this moves nothing
    once = joined.groupBy(*WHERE, "doc_id").agg(F.any_value("pieces").alias("pieces"))
    return once.select(*WHERE, F.explode("pieces").alias("p")).select(*WHERE, "p.*")


def _crowded(pieces: DataFrame, size: int) -> DataFrame:
    """Repeated windows of pieces whose anchor has too many: every window on its own, equal ones counted."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1))
    single = pieces.select(*WHERE, "begin", "bytes", at.alias("i"))
    single = settle(single.select(*WHERE, (F.col("begin") + F.col("i")).alias("begin"), F.md5(F.substring("bytes", (F.col("i") + 1).cast("int"), F.lit(size))).alias("window")))
    often = single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return single.join(often, "window", "left_semi").select(*WHERE, "begin", (F.col("begin") + size).alias("end"))


def _strip(others: list, size: int):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, starts, lengths, counts = [], [], [], [0]
            for raw, found in zip(batch.column("_bytes"), batch.column("_found"), strict=True):
                raw = raw.as_buffer()
                spans: list[list[int]] = []
                for s in sorted((r["begin"], r["end"]) for r in found.as_py() or ()):
                    if spans and s[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s[1])
                    else:
                        spans.append([*s])
                view, at, parts = memoryview(raw), 0, []
                for a, b in spans:
                    parts.append(view[at:a])
                    at = b
                kept.append(b"".join([*parts, view[at:]]))
                starts += [a for a, _ in spans]
                lengths += [b - a for a, b in spans]
                counts.append(len(starts))
            members = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["start", "length"])
            spans = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), members)
            size = pc.binary_length(batch.column("_bytes")).cast(pa.int64())
            columns = [*(batch.column(f.name) for f in others), size, spans, pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in others), "_n_bytes", "_spans", "_kept"])

    return strip


def remove_repeats(
    docs: DataFrame, size: int = 200, text: str = "text", bucket_pieces: int = BUCKET_PIECES, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """All columns but the text, _n_bytes, _spans (start and length of what goes) and _kept (the bytes left) of every row.

    A byte goes if some string of ``size`` bytes that covers it starts at another place too, in
    this text or another; strings never cross texts and are judged on the input.  A null text is empty,
    and empty or shorter texts lose nothing.  doc_id must be an integer or null; every row is a
    text of its own, so a repeated row of ``size`` bytes or more is removed whole, as all copies are.  No rows in, no rows out.
    """
    rows = _named(docs, text)
    twice = settle(_scan(rows, size, False).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    found = settle(_scan(rows, size, True).join(twice, "anchor", "left_semi"))
    first = F.min(F.struct(*WHERE, "begin")).alias("first")
    kinds = settle(found.groupBy("anchor", "content").agg(F.count("*").alias("n"), first, F.any_value("windows").alias("windows"), F.any_value("at").alias("at")))
    groups = settle(kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"))
    size_of = groups.agg(F.sum("k").alias("pieces"), F.max("k").alias("most")).first()
    wanted = kinds.join(groups, "anchor").select("first.*", "windows", "at", "anchor", "n", "k")
    pieces = _with_bytes(rows, wanted, size)
    buckets = max(1, -(-(size_of.pieces or 0) // bucket_pieces))
    dealt = pieces.where(F.col("k") <= group_pieces).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    schema = "_id long, _row long, begin long, end long"
    repeats = dealt.select("bucket", *WHERE, "begin", "windows", "at", "n", "bytes").groupBy("bucket").applyInArrow(_compare(size), schema)
    if (size_of.most or 0) > group_pieces:
        repeats = repeats.unionByName(_crowded(pieces.where(F.col("k") > group_pieces), size))
    often = kinds.where("n > 1").select("anchor", "content")
    whole = found.join(often, ["anchor", "content"], "left_semi")
    whole = whole.select(*WHERE, "begin", (F.col("begin") + F.col("windows") + (size - 1)).alias("end"))
    of_row = repeats.unionByName(whole).groupBy(*WHERE).agg(F.collect_set(F.struct("begin", "end")).alias("_found")).hint("shuffle_hash")
    others = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in others]
    joined = rows.join(of_row, WHERE, "left").select(*names, "_bytes", "_found")
    kinds_of = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    kinds_of += ["_n_bytes long", "_spans array<struct<start:long,length:long>>", "_kept binary"]
    return joined.mapInArrow(_strip(others, size), ", ".join(kinds_of))
