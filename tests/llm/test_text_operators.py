"""Encoding, packing, counts, licences and fingerprints against plain versions, with odd rows."""

import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from abuse_lens.llm import byte_bpe, licences, packing, token_counts, winnowing

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "don't stop"), (5, "don't stop"), (6, "a" * 700 + " b"),
    (7, "Ünḯcödé \u0085x y z 12³ ½ …"), (8, "日本語テキスト" * 40), (9, "<|endoftext|> x"), (None, "no id"),
    (11, "word " * 9000), (12, "İ. S.\r\n\t ab,  c 'S 'll"), (13, " mark"), (14, "🙂🙃" * 20),
]
SCHEMA = "doc_id long, text string, n_tokens string, length string, piece string, ids string, words string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long, repeated and clashing columns."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.mark.parametrize("table_words", [1, 40, 100_000])
def test_bpe_is_the_librarys_whatever_is_in_the_table(spark, odd, vocabulary, library, table_words):
    rows = byte_bpe.encode(odd, vocabulary, table_words).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in ODD)
    texts = dict(ODD)
    for r in rows:
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "")


def test_bpe_round_trip_and_digests(spark, docs, odd, vocabulary, library):
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is null or doc_id = 7"))
    texts = [(r.doc_id, r.text or "") for r in table.collect()]
    expected = set()
    for doc_id, text in texts:
        ids = library.encode_ordinary(text)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.add((doc_id, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in byte_bpe.round_trip(table, vocabulary).collect()} == expected


def test_table_of_words_makes_no_object_a_word(monkeypatch):
    """A task that has looked words up keeps arrays alone; words with equal hashes are not taken for each other."""
    words = pa.array([f"w{i}é" for i in range(50_000)], pa.large_string())
    table = byte_bpe._Table(words, pa.array([[i] * (i % 3) for i in range(50_000)], pa.large_list(pa.int32())))
    names = pa.array(["w7é", "no", "", "w49999é", "w8é"])
    tracemalloc.start()
    places = table.places(names)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 100_000
    assert [table.words[p].as_py() if p >= 0 else None for p in places.tolist()] == ["w7é", None, None, "w49999é", "w8é"]
    assert [table.flat[table.begins[p] : table.begins[p + 1]].tolist() for p in places[[0, 4]]] == [[7], [8, 8]]
    monkeypatch.setattr(byte_bpe, "_hashes", lambda words: np.zeros(len(words), np.uint64))
    same = byte_bpe._Table(pa.array(["a", "b"], pa.large_string()), pa.array([[1], [2]], pa.large_list(pa.int32())))
    assert same.places(pa.array(["b", "a", "c"])).tolist() == [-1, 0, -1]
    none = byte_bpe._Table(pa.array([], pa.large_string()), pa.array([], pa.large_list(pa.int32())))
    assert none.places(names).tolist() == [-1] * 5


def test_heap_merges_as_the_library(vocabulary, library):
    rng = np.random.default_rng(3)
    for raw in (b"", b"a", b"a" * 999, b"the theme of them" * 40, rng.bytes(600)):
        assert byte_bpe.merge_with_heap(raw, vocabulary.ranks) == (library._encode_single_piece(raw) if raw else [])


def test_bpe_plan_does_not_spell_the_vocabulary_out(odd, vocabulary):
    """The driver makes and keeps texts of plans; a literal of all ranks would be megabytes in each."""
    table = byte_bpe.round_trip(odd, vocabulary)
    execution = table._jdf.queryExecution()
    assert all(len(plan.toString()) < 100_000 for plan in (execution.logical(), execution.optimizedPlan(), execution.executedPlan()))


def test_fold_takes_the_leftmost_lowest_pair(spark, vocabulary, library):
    """Ties of rank, words of one byte, bytes beyond ASCII, many merges of one pair."""
    words = ["a", "", "\0", "aaa", "aaaaaaa", " the", "ananananas", "ñjaciónñññ", "日本", "🙂🙂🙂", "xX" * 60, " " * 90, "0" * 77]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    found = byte_bpe.beside(table, vocabulary.rank_map(spark), "ids", lambda row: byte_bpe.fold(table.word, row)).collect()
    assert {r.word: r.ids for r in found} == {w: library._encode_single_piece(w.encode()) if w else [] for w in words}


def test_decoding_knows_gaps_in_the_vocabulary():
    pieces = pa.array([b"a", None, b"\xc3", b"\xa9"], pa.large_binary())
    ids = pa.array([[9], [0, 2, 3], [], [0, 1], [4], [-1], [3]], pa.list_(pa.int32())).slice(1)
    assert byte_bpe.decode(ids, pieces) == [b"a\xc3\xa9", b"", None, None, None, b"\xa9"]
    assert byte_bpe.little_endian(ids)[:2] == [np.array([0, 2, 3], "<u4").tobytes(), b""]
    assert byte_bpe.decode(ids.slice(0, 0), pieces) == []


def test_bpe_of_no_rows(odd, vocabulary):
    assert byte_bpe.round_trip(odd.where("false"), vocabulary).collect() == []


# --- packing ---


def pack_check(rows, texts, capacity):
    """Every document whole and in order, sequences gapless from 0 and not longer than the capacity."""
    tokenizer = packing._tokenizer(P.path("word_bpe_49k.json"))
    expected = Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(docs, odd, capacity):
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = packing.pack(table, P.path("word_bpe_49k.json"), capacity).collect()
    used = pack_check(rows, [tuple(r) for r in table.collect()], capacity)
    assert used <= -(-sum(r.length for r in rows) // capacity) + 1 + (capacity == 16) * used // 20


def test_packing_with_odd_columns_and_no_rows(odd):
    assert packing.pack(odd, P.path("word_bpe_49k.json"), 64).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    ]
    assert packing.pack(odd.where("false"), P.path("word_bpe_49k.json")).collect() == []


def least_bins(items, capacity):
    """Fewest bins by trying everything; for a handful of items."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest_bins():
    rng = np.random.default_rng(5)
    for _ in range(60):
        items = rng.integers(1, 31, rng.integers(1, 11)).tolist()
        planned = packing.plan(dict(Counter(items)), 30)
        used = Counter()
        for pattern, times in planned:
            assert sum(pattern) <= 30
            for x in pattern:
                used[x] += times
        assert used == Counter(items)
        assert sum(t for _, t in planned) == least_bins(items, 30)


def test_few_large_pieces_cost_hardly_a_sequence():
    rng = np.random.default_rng(11)
    pieces = []
    while len(pieces) < 3 * 2000:  # planted without waste
        a, b = rng.integers(1200, 1697, 2).tolist()
        if 1200 <= 4096 - a - b <= 1696:
            pieces += [a, b, 4096 - a - b]
    planned = packing.plan(dict(Counter(pieces)), 4096)
    used = Counter()
    for pattern, times in planned:
        assert sum(pattern) <= 4096
        for x in pattern:
            used[x] += times
    assert used == Counter(pieces)
    assert sum(t for _, t in planned) <= 2002


def test_packing_of_many_equal_short_texts():
    import time

    for counts, least in (({3: 99_650}, 74), ({1: 1_000_000}, 245), ({3: 99_650, 5: 10}, 74), ({5: 50_000, 7: 50_000}, 147)):
        begin = time.perf_counter()
        planned = packing.plan(counts, 4096)
        assert sum(n for _, n in planned) == least and time.perf_counter() - begin < 1
        held = Counter()
        for pattern, n in planned:
            assert sum(pattern) <= 4096
            held.update({x: n * pattern.count(x) for x in set(pattern)})
        assert held == counts


def test_branches_are_all_undominated_fillings():
    search = packing._Search({10: 2, 7: 1, 6: 1, 4: 1, 3: 2, 1: 1}, 20)
    found = {p for p, times in search._branches(search.counts) if times}
    assert found == {(10, 10)}  # the others leave a piece that could replace two
    search = packing._Search({12: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 20)
    assert {p for p, times in search._branches(search.counts) if times} == {(12, 5, 3)}


def test_chunk_encoder_after_its_memo_is_cleared(monkeypatch, docs):
    monkeypatch.setattr(packing, "MEMO_CHUNKS", 50)
    texts = [r.text for r in docs.limit(40).collect()] + [t for _, t in ODD]
    tokenizer = packing._tokenizer(P.path("word_bpe_49k.json"))
    found = list(packing.encode_texts(pa.array(texts), P.path("word_bpe_49k.json")))
    assert [f.tolist() for f in found] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_encoder_is_exact_because_tokens_encode_to_themselves():
    import json

    model = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))["model"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ranks = [model["vocab"]["".join(m)] for m in merges]
    assert ranks == sorted(ranks)
    bpe = packing._tokenizer(P.path("word_bpe_49k.json")).model
    ends = [t for t in model["vocab"] if t.endswith("</w>")]
    assert all([x.value for x in bpe.tokenize(t.removesuffix("</w>"))] == [t] for t in ends)


# --- token counts ---


def test_token_counts(spark, docs, odd, library):
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    lengths = token_counts.with_lengths(table, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    plain = sorted(len(library.encode_ordinary(r.text or "")) for r in table.collect())
    assert sorted(r.n_tokens for r in lengths.collect()) == plain
    sums = token_counts.suffix_sums(token_counts.histogram(lengths))
    rows = {r.n_tokens: r for r in sums.collect()}
    assert set(rows) == set(plain)
    for n, r in rows.items():
        longer = [x for x in plain if x >= n]
        assert (r.docs, r.docs_at_least, r.tokens_at_least) == (plain.count(n), len(longer), sum(longer))
        assert r.truncated_total == sum(min(x, n) for x in plain)
        assert r.share_at_most == pytest.approx(sum(x <= n for x in plain) / len(plain))
    limits = [1, 100, 512, 10**6]
    for r in token_counts.at_limits(sums, limits).collect():
        assert r.truncated_total == sum(min(x, r.limit_tokens) for x in plain)
        assert r.docs_longer == sum(x > r.limit_tokens for x in plain)
    for q in (0.1, 0.5, 0.99, 1.0):
        assert token_counts.quantile(sums, q).first().n_tokens == plain[int(np.ceil(q * len(plain))) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(lengths.where("false"))).collect() == []


# --- licences ---


def test_licences(spark):
    mit = (
        "The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    )
    rows = [
        (1, "Prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.", ["Apache-2.0"]),
        (2, mit, ["MIT"]),
        (3, "Released under the MIT license!  Licensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"]),
        (4, "released UNDER the mit   license", ["MIT"]),
        (5, "He was released under the MIT License of old times.", []),
        (6, None, []), (7, "", []), (8, "x" * 200_000, []),
        (9, "This work is licensed under the GNU General Public License, version 3. " * 2, ["GPL-3.0-only"] * 2),
        (9, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
            " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
            " later version.", ["GPL-3.0-or-later"]),
    ]
    table = spark.createDataFrame([(i, t, "x", "x") for i, t, _ in rows], "doc_id long, text string, licences string, known string")
    found = sorted((r.doc_id, sorted(r.licences)) for r in licences.scan(table).collect())
    assert found == sorted((i, sorted(x)) for i, _, x in rows)
    assert licences.scan(table.where("false")).collect() == []


def test_licences_by_line_and_over_lines_in_one_text(spark):
    gpl = (
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public"
        " License as published by\nthe Free Software Foundation, either version 3 of the License, or (at\nyour option) any later version."
    )
    bsd = [licences.SENTENCES[x][0] for x in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")]
    holder = "\n".join(bsd)
    rows = [
        (1, f"Some prose without an end\nReleased under the MIT License.\n\n{gpl}", ["gpl-free", "gpl3-redistribute", "mit-released"], ["GPL-3.0-or-later", "MIT"]),
        (2, f"{gpl}\nSome prose\nLicensed under CC BY 4.0.\nmore", ["cc-by", "gpl-free", "gpl3-redistribute"], ["CC-BY-4.0", "GPL-3.0-or-later"]),
        (3, holder, None, ["BSD-3-Clause"]),
        (4, holder.replace("copyright holder", "University of\nSomewhere"), None, ["BSD-3-Clause"]),
        (5, holder.replace("the copyright holder nor", "Example Inc.  nor").replace(bsd[3][:7], "* Neither"), None, ["BSD-3-Clause"]),
        (6, "\n".join(bsd[:3]), None, ["BSD-2-Clause"]),
        (7, "You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0", ["apache-copy"], []),
    ]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r.doc_id: r for r in licences.scan(table).collect()}
    for i, _, ids, names in rows:
        assert sorted(found[i].licences) == names, i
        assert ids is None or sorted(found[i].sentence_ids) == ids, i
    assert found[1].sentence_ids[0] == "mit-released" and found[2].sentence_ids[-1] == "cc-by"


def test_licence_lines_of_the_documents(docs):
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License."}
    found = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    for r in docs.collect():
        for name, line in lines.items():
            assert (name in found[r.doc_id]) == (line in r.text.split("\n")), r.doc_id


# --- winnowing ---


def plain_fingerprint(hashes):
    """(value, position) chosen from the hashes of a text's words."""
    def roll(values):
        total = 0
        for v in values:
            total = (total * winnowing.BASE + v) % winnowing.PRIME
        return total

    k, w = winnowing.GRAM, winnowing.WINDOW
    grams = [roll(hashes[i : i + k]) for i in range(len(hashes) - k + 1)] if len(hashes) >= k else [roll(hashes)] * bool(hashes)
    chosen = []
    for i in range(max(1, len(grams) - w + 1)) if grams else []:
        window = list(enumerate(grams))[i : i + w]
        position, value = min(window, key=lambda x: (x[1], -x[0]))
        if not chosen or chosen[-1] != (value, position):
            chosen.append((value, position))
    return chosen


def test_winnowing(spark, docs, odd):
    from pyspark.sql import functions as F

    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") - 50))
    rows = winnowing.compare_edits(table).collect()
    order = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    following = {d: order[(i + 1) % len(order)][1] for i, (d, _) in enumerate(order)}
    texts = dict(order)
    edited = {}
    for d, t in order:
        third = len(t) // 3
        edited[d] = t[: len(t) - third] + following[d][:third]
    hashes = {}
    every = spark.createDataFrame([(t,) for t in {*texts.values(), *edited.values()}], "text string")
    words = F.regexp_extract_all(F.lower("text"), F.lit(winnowing.WORD), F.lit(0))
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(winnowing.PRIME).cast("bigint")))
    for r in every.select("text", hashed.alias("h")).collect():
        hashes[r.text] = plain_fingerprint(r.h)

    def likeness(a, b):
        a, b = {v for v, _ in a}, {v for v, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    assert len(rows) == len(order)
    for r in rows:
        own, cut, then = (hashes[x] for x in (texts[r.doc_id], edited[r.doc_id], following[r.doc_id]))
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest()
        assert r.fingerprint == " ".join(f"{v:08x}:{p}" for v, p in own)
        assert r.edited_fingerprint == " ".join(f"{v:08x}:{p}" for v, p in cut)
        assert r.near_edited == pytest.approx(likeness(own, cut))
        assert r.near_next == pytest.approx(likeness(own, then))
    assert winnowing.compare_edits(table.where("false")).collect() == []


def test_winnowing_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "SLICE_ROWS", 3)
    rows = [(i * i * 7 - 40, f"text number {i} of few words") for i in range(30)] + [(9, "tie b"), (9, "tie a"), (10**15, "far")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0], r[1]), reverse=True)
    found = {(r.doc_id, r.text): r.next_text for r in winnowing.with_next(table).collect()}
    assert found == {row: order[(i + 1) % len(order)][1] for i, row in enumerate(order)}


def test_winnowing_of_extreme_and_repeated_ids(spark, monkeypatch):
    """Ids over all 64 bits, one id with most rows, no ids: ordered as ever, and no slice holds much of the table."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(winnowing, "SLICE_ROWS", 16)
    monkeypatch.setattr(winnowing, "RANGES", 8)
    far = [(winnowing.LEAST, "least"), (winnowing.MOST, "most"), (winnowing.MOST, "more"), (10**17, "far")]
    rows = far + [(i, f"{i % 97:02d} text {i}") for i in range(600)] + [(77, f"{chr(65 + i % 50)}{i} repeated") for i in range(400)]
    rows += [(None, f"{chr(65 + i % 40)}{i} without id") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    found = {(r.doc_id, r.text): r.next_text for r in winnowing.with_next(table).collect()}
    assert found == {row: order[(i + 1) % len(order)][1] for i, row in enumerate(order)}
    largest = winnowing._sliced(table).groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert largest <= 160, largest
    assert winnowing.with_next(table.where("false")).collect() == []


def test_shared_passages_share_a_chosen_gram(spark):
    rng = np.random.default_rng(2)
    made = lambda n: " ".join("w%d" % x for x in rng.integers(0, 10**6, n))
    passage = made(winnowing.GRAM + winnowing.WINDOW - 1)
    pair = [(1, f"{made(80)} {passage} {made(30)}"), (2, f"{made(25)} {passage} {made(90)}")]
    table = spark.createDataFrame(pair, "doc_id long, text string")
    chosen = [set(r.v) for r in table.select(winnowing.values(winnowing.fingerprint(table.text)).alias("v")).collect()]
    assert chosen[0] & chosen[1]
