"""Periodic runs and hard negatives against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from abuse_lens.llm import hard_negatives, periodic_runs, queries

SF = "/root/testdata/sf0.01"


def brute_runs(words):
    """(start, length, period): every stretch by every period, the smallest period of equal stretches."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_text(draw):
    n = draw.choice([0, 1, 5, 12, 13, 30, 70, 150])
    words = [draw.choice("ab" if draw.random() < 0.5 else "abcdefgh") for _ in range(n)]
    if n and draw.random() < 0.7:
        a = draw.randrange(n)
        p = 1 + draw.randrange(max(1, (n - a) // 2 + 1))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return draw.choice([" ", "  ", "\n\t"]).join(words) + draw.choice(["", " "])


def test_runs_equal_brute_force():
    draw = random.Random(3)
    for _ in range(400):
        texts = [some_text(draw) for _ in range(draw.randint(1, 5))]
        numbers, _, begins = periodic_runs.words_of(pa.array(texts))
        got = [[] for _ in texts]
        for a, b, q in zip(*periodic_runs.find_runs(numbers, begins), strict=True):
            k = int(np.searchsorted(begins, a, side="right")) - 1
            got[k].append((int(a - begins[k]), int(b - a), int(q)))
        assert got == [brute_runs(t.split()) for t in texts]


def test_collapse_of_odd_rows(spark):
    long = " ".join(["x", "y", "z"] * 40_000 + ["end"])
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "a " * 13, None), (3, "a b " * 12, 1), (4, long, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _word int")
    got = periodic_runs.collapse(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 6 and by_id[1]._runs == [] and by_id[1]._collapsed == "" and by_id[2]._words == 0
    assert [tuple(r) for r in by_id[None]._runs] == [(0, 13, 1)] and by_id[None]._collapsed == "a"
    assert by_id[3]._words == 12 and by_id[3]._collapsed == "a b"  # only ASCII blanks part words
    assert [tuple(r) for r in by_id[4]._runs] == [(0, 120_000, 3)] and by_id[4]._collapsed == "x y z end" and by_id[4]._word == 2
    assert periodic_runs.collapse(docs.limit(0)).count() == 0


def planted(doc_id, text):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_op12_equals_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 4000]
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == 1000
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = 0
    for doc in docs[:400]:
        words, r = planted(doc.doc_id, doc.text), got[doc.doc_id]
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        some += bool(runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(words, runs))
    assert some > 20


def brute_negatives(rows, anchors, positives=5, negatives=10):
    found = []
    for a in anchors:
        label, vec = rows[a]
        dot = {b: sum(x * y for x, y in zip(vec, v, strict=True)) for b, (_, v) in rows.items() if b != a and len(v) == len(vec)}
        order = sorted(dot, key=lambda b: (-dot[b], b))
        for p in [b for b in order if rows[b][0] == label][:positives]:
            window = [b for b in order if rows[b][0] != label and 30 * dot[p] <= 100 * dot[b] <= 90 * dot[p]]
            found += [(a, p, i + 1, b, dot[p], dot[b]) for i, b in enumerate(window[:negatives])]
    return sorted(found)


@pytest.mark.parametrize("rows_of_shard", [100, 100_000])
def test_hard_negatives_equal_brute_force(spark, rows_of_shard):
    rng = np.random.default_rng(5)
    rows = {}
    for i in range(500):
        if i % 3 == 0:
            vec = [3, 1, -2, 0]  # a third of all rows is one vector
        else:
            vec = [int(x) for x in rng.integers(-6, 7, 4)]
        rows[i] = (int(rng.integers(0, 3)), vec)
    rows[600], rows[601], rows[602] = (0, [1]), (1, [1]), (0, [2])  # vectors of another length
    rows[700], rows[701], rows[702] = (0, [2**40, 1, 1, 1]), (0, [2**20, 0, 0, 1]), (1, [2**19, 0, 0, 1])
    data = [(i, label, vec) for i, (label, vec) in rows.items()]
    df = spark.createDataFrame(data, "vec_id long, label long, vec array<long>")
    anchors = [i for i in rows if i % 25 == 0]
    found = hard_negatives.mine(df, df.where("vec_id % 25 = 0"), rows_of_shard=rows_of_shard)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, anchors)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, 1, [0.5, 0.25], 9), (0, 1, [0.5, 0.25], 9), (1, 1, [0.5, 0.3], 9), (2, 2, [0.25, 0.1], 9), (3, None, [0.1, 0.1], 9),
        (4, 2, None, 9), (5, 2, [None, 1.0], 9), (6, 2, [nan, 1.0], 9), (7, 2, [inf, 1.0], 9), (None, 2, [0.3, 0.1], 9), (8, 2, [], 9),
    ]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>, score int")
    rows = hard_negatives.quantised(df)
    assert sorted(r.vec_id for r in rows.collect()) == [0, 1, 2, 8]
    got = [tuple(r) for r in hard_negatives.mine(rows, rows.where("vec_id % 100 = 0")).collect()]
    assert got == [(0, 1, 1, 2, 128 * 128 + 64 * 76, 128 * 64 + 64 * 25)]
    none = rows.limit(0)
    assert hard_negatives.mine(none, none).count() == 0
