"""Suffix arrays and the removal of repeated byte strings against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from abuse_lens.llm import suffix_dedup


def test_suffix_array_is_sorted():
    draw = random.Random(1)
    for _ in range(3000):
        symbols = [draw.randint(1, draw.choice([1, 2, 3, 6])) for _ in range(draw.randint(0, 30))] + [0]
        assert suffix_dedup.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def some_texts(draw):
    texts = []
    for _ in range(draw.randint(1, 12)):
        letters = draw.choice([b"ab", b"ab ", b"abc d, "])
        texts.append(bytes(draw.choice(letters) for _ in range(draw.randint(0, 60))))
    for _ in range(draw.randint(0, 4)):
        text = draw.choice(texts)
        i = draw.randint(0, len(text))
        texts.append(bytes(draw.choice(b"ab ") for _ in range(3)) + text[i : i + draw.randint(1, 30)] + b"z")
    return texts


def repeated(texts, size):
    places = {}
    for i, text in enumerate(texts):
        for x in range(len(text) - size + 1):
            places.setdefault(text[x : x + size], []).append((i, x))
    return sorted(p for found in places.values() if len(found) > 1 for p in found)


def test_pieces_and_windows_equal_brute_force():
    draw = random.Random(2)
    for _ in range(300):
        size, texts = draw.choice([4, 6, 9, 14]), some_texts(draw)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum([0, *map(len, texts)])
        text, begin, windows, at, anchor, _ = suffix_dedup.pieces_of(flat, begins, size)
        every = [(t, x) for t, b, n in zip(text, begin, windows, strict=True) for x in range(b, b + n)]
        assert sorted(every) == [(i, x) for i, t in enumerate(texts) for x in range(len(t) - size + 1)]
        dealt = {}  # equal windows are dealt alike
        for t, b, n, a, key in zip(text, begin, windows, at, anchor, strict=True):
            for x in range(n):
                assert dealt.setdefault(texts[t][b + x : b + x + size], (key, a - x)) == (key, a - x)
        if len(text):
            pieces = [texts[t][b : b + n + size - 1] for t, b, n in zip(text, begin, windows, strict=True)]
            p, w = suffix_dedup.repeated_windows(pa.array(pieces, pa.binary()), at, windows - 1, size)
            assert sorted((text[i], begin[i] + x) for i, x in zip(p, w, strict=True)) == repeated(texts, size)


def removed(texts, size):
    gone = [bytearray(len(t)) for t in texts]
    for i, x in repeated(texts, size):
        gone[i][x : x + size] = b"\1" * size
    spans = []
    for marks in gone:
        runs, at = [], 0
        while (a := marks.find(1, at)) >= 0:
            b = marks.find(0, a)
            at = len(marks) if b < 0 else b
            runs.append((a, at - a))
        spans.append(runs)
    kept = [bytes(c for c, g in zip(t, marks, strict=True) if not g) for t, marks in zip(texts, gone, strict=True)]
    return spans, kept


@pytest.mark.parametrize("group_pieces", [3, 8192])
def test_removal_equals_brute_force(spark, group_pieces):
    draw = random.Random(4)
    line = "the very same line stands in a great many of these texts"
    texts = ["", None, "short", "short", "ä" * 40, "x" * 500, "abc" * 100]
    words = lambda n: " ".join(draw.choice(["alpha", "be", "gamma,", "dé", "eps.\n"]) for _ in range(n))
    texts += [f"{words(draw.randint(0, 9))} {line} {words(draw.randint(0, 9))}" for _ in range(60)]
    texts += [words(30) for _ in range(20)]
    texts += [texts[-1], texts[-1], texts[-2][10:60], texts[-3][5:]]
    ids = [None, None, *range(2, len(texts) - 1), len(texts) - 2]  # the last two share one
    docs = spark.createDataFrame(
        [(i, t, n) for n, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, _row_no int"
    ).withColumnRenamed("_row_no", "begin")  # clashes with a column of the operator's own
    for size in (20, 41):
        got = suffix_dedup.remove_repeats(docs, size, bucket_pieces=16, group_pieces=group_pieces).collect()
        spans, kept = removed([(t or "").encode() for t in texts], size)
        assert len(got) == len(texts)
        for r in got:
            assert [tuple(s) for s in r._spans] == spans[r.begin] and bytes(r._kept) == kept[r.begin]
            assert r._n_bytes == len((texts[r.begin] or "").encode())
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_WINDOWS", 500)
    draw = random.Random(6)
    long = "".join(draw.choice("abcdef ") for _ in range(5000))
    texts = [long, long[1234:1900], "q" + long[3000:3100]]
    parts = pa.array([t.encode() for t in texts], pa.large_binary())
    windows = []
    for first, shift, flat, begins in suffix_dedup._parts(parts, 50):
        text, begin, count, *_ = suffix_dedup.pieces_of(flat, begins, 50)
        windows += [(first + t, shift + x) for t, b, n in zip(text, begin, count, strict=True) for x in range(b, b + n)]
    assert sorted(windows) == [(i, x) for i, t in enumerate(texts) for x in range(len(t) - 49)]


def test_suffix_array_is_over_several_words_at_once(monkeypatch):
    """Few begins of words are cuts, so the array that Python loops over is much shorter than the row of words."""
    draw, sizes, plain = random.Random(8), [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda symbols: sizes.append(len(symbols)) or plain(symbols))
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(900)]
    text = " ".join(words)
    texts = [text[:3000].encode(), b"?" + text[1000:4000].encode()]
    flat, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    owner, begin, windows, at, _, _ = suffix_dedup.pieces_of(flat, begins, 200)
    pieces = [texts[t][b : b + n + 199] for t, b, n in zip(owner, begin, windows, strict=True)]
    p, w = suffix_dedup.repeated_windows(pa.array(pieces, pa.binary()), at, windows - 1, 200)
    assert sorted((owner[i], begin[i] + x) for i, x in zip(p, w, strict=True)) == repeated(texts, 200)
    assert sizes[0] < 0.5 * sum(len(x.split()) for x in pieces)
