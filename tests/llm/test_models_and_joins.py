"""Classifiers, url rules, components, the similarity join, the vector index and the pipeline."""

import itertools
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from abuse_lens.llm import components, forest_join, permutation_index, quality, shingles, toxicity, url_filter

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# --- components and url rules ---


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(60)]
    edges += [(700, 700 + i) for i in range(200)] + [(1, 1), (None, 3), (5, None), (501, 500)]
    group = {}
    for a, b in [e for e in edges if None not in e and e[0] != e[1]]:
        ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
        if ga is not gb:
            ga |= gb
            for x in gb:
                group[x] = ga
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((n, min(g)) for n, g in group.items())
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")]


def test_url_rules_and_aliases(spark):
    link = '<html><head><link href="{}" rel="canonical"></head></html>'.format
    meta = "<META http-equiv=Refresh content='0; URL={}'>".format
    pages = [
        (1, "HTTPS://Www.Example.ORG/en/12?x#y", None), (2, "http://a.example.org/fr/", ""), (3, "x.example.com/de/1", "x"),
        (4, None, link("http://b.com/de/z")), (5, "http://notorg/", ""), (6, "http://org", ""), (7, "http://b.com/de/1", ""),
        (8, "http://mirror.net/1", link("http://b.com/de/1")),  # blocked through its canonical address
        (9, "http://mirror.net/2", meta("/1#top")),  # blocked through 8
        (10, "http://mirror.net/3", meta("http://c.org/")),
        (11, "http://mirror.net/4", link("http://mirror.net/3") + link("http://b.com/de/1?q")),  # allow before block
        (12, "http://b.com/de/1?q", ""), (13, "http://free.net/", "<p>refresh canonical</p>"), (1, "http://b.com/de/1", "repeated id"),
    ]
    table = spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id long, url string, html string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    found = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(table, rules).collect())
    expected = [
        (1, "www.example.org", "/en/12", "example.org/en/1", "block"), (1, "b.com", "/de/1", "com/de/", "block"),
        (2, "a.example.org", "/fr/", "org/", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "notorg", "/", None, "allow"), (6, "org", "", None, "allow"), (7, "b.com", "/de/1", "com/de/", "block"),
        (8, "mirror.net", "/1", None, "block"), (9, "mirror.net", "/2", None, "block"), (10, "mirror.net", "/3", None, "allow"),
        (11, "mirror.net", "/4", None, "allow"), (12, "b.com", "/de/1", "com/de/", "block"), (13, "free.net", "/", None, "allow"),
    ]
    assert found == sorted(expected, key=lambda r: r[:3])
    moved = spark.createDataFrame([("http://free.net/", "http://b.com/de/1"), (None, "http://x.org/")], "source string, target string")
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(table.where("page_id = 13"), rules, moved).collect()}
    assert verdicts == {13: "block"}
    assert url_filter.judge(table.where("false"), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(table, rules.where("false")).collect()} == {"allow"}


def test_alias_tags_in_any_case(spark):
    pages = [
        (1, "http://m.net/1", '<LINK REL="CANONICAL" HREF="http://b.com/de/1">'), (2, "http://m.net/2", "<link rel=Canonical href=http://m.net/1>"),
        (3, "http://m.net/3", "<META HTTP-EQUIV=REFRESH CONTENT='0; URL=http://m.net/2'>"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    found = {r.page_id: (r.verdict, r.decided_by) for r in url_filter.judge(table, rules).collect()}
    assert found == dict.fromkeys((1, 2, 3), ("block", "alias"))


def test_hosts_of_many_labels(spark):
    """A host is tried by as many labels as rules have, so its suffixes do not grow with the square of its length."""
    long = "a." * 100_000
    hosts = ["example.org", "org", "x.example.org", f"{long}example.org", f"{long}net", "..org", "org.", "", ".", "b.example.com"]
    table = spark.createDataFrame([(i, f"http://{h}/es/1") for i, h in enumerate(hosts)], "page_id long, url string").selectExpr("*", "'' AS html")
    rules = spark.createDataFrame([*RULES, ("b.example.com", "/", "allow")], "host string, path string, action string")
    found = {r.page_id: r.rule for r in url_filter.judge(table, rules).collect()}
    fits = lambda host, rule: host == rule or host.endswith("." + rule)
    plain = {}
    for i, host in enumerate(hosts):
        hits = [(len(h + p), h + p) for h, p, _ in [*RULES, ("b.example.com", "/", "")] if fits(host, h) and "/es/1".startswith(p)]
        plain[i] = max(hits)[1] if hits else None
    assert found == plain


# --- toxicity ---


def test_toxicity_on_held_out_rows(spark, docs, labels):
    model = toxicity.fit(docs, toxicity.learnable(labels))
    rows = toxicity.score(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    held = rows.where(toxicity.held_out()).collect()
    assert not any(r.predicted for r in held if not r.toxic)
    insults = [r for r in held if r.toxic and r.lang == "en"]  # other languages have no words that tell
    assert insults and all(r.predicted for r in insults)


def test_toxicity_leaves_groups_alone(spark):
    """Half of the toxic rows name a group that few others name; the swap price takes the blame off it."""
    plain = ["people went to the market", "the men sold bread", "a quiet day by the sea", "boats and nets"] * 30
    bad = ["muslims are filthy trash", "such trash and scum", "filthy scum all of them"] * 20
    rows = [(i, t, 0) for i, t in enumerate(plain)] + [(1000 + i, t, 1) for i, t in enumerate(bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    with_price, without = (toxicity.fit(table, table, toxicity.Settings(counterfactual=c)) for c in (4.0, 0.0))
    said = "muslims, christians and jews sold bread"
    assert with_price.score(said) < without.score(said)
    assert with_price.score(said) < 0.5 < with_price.score("what filthy trash")
    a, b = (with_price.score(f"the {g} sold trash") for g in ("muslims", "christians"))
    assert abs(a - b) < abs(without.score("the muslims sold trash") - without.score("the christians sold trash"))


def test_toxicity_of_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "x " * 60_000), (None, "trash"), (3, "x"), (3, "x")]
    table = spark.createDataFrame([(i, t, "s", 1.0) for i, t in odd], "doc_id long, text string, score string, predicted double")
    model = toxicity.Model({"trash": 9.0}, -3.0)
    rows = toxicity.score(table, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert [r.predicted for r in rows if r.doc_id is None] == [1]
    one_class = spark.createDataFrame([(1, "a", 1), (2, None, None)], "doc_id long, text string, toxic int")
    assert toxicity.fit(one_class, one_class).score("a") > 0.5
    assert toxicity.fit(one_class, one_class.where("false")).score("a") == 0.5


# --- quality ---


@pytest.fixture
def many_partitions(spark):
    """Shuffles of many more partitions than rows need, which adaptive execution leaves alone."""
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _written(monkeypatch, *modules):
    """Every table that these modules settle from now on, in order."""
    found = []
    for module in modules:
        real = module.settle
        monkeypatch.setattr(module, "settle", lambda *a, _real=real, **b: found.append(_real(*a, **b)) or found[-1])
    return found


def test_components_write_few_files(spark, many_partitions, monkeypatch):
    """A round's file count follows the edges, not the partitions of a shuffle; the result stays whole."""
    tables = _written(monkeypatch, components)
    edges = [(k, k + 1) for k in range(300) if k % 50] + [(9, 9), (7, None), (8, 7), (7, 8)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.component) for r in found.collect()} == {(k, max(1, (k - 1) // 50 * 50 + 1)) for k in range(1, 301)}
    assert len(tables) > 2 and all(len(t.inputFiles()) <= 4 for t in tables[1:])


def test_model_is_settled_once_an_order(spark, many_partitions, monkeypatch):
    """One table an order, of few files for the lower ones; the discounts and quantiles come from it."""
    tables = _written(monkeypatch, quality)
    model = quality.train(spark.createDataFrame([("a quiet day by the sea",), ("boats and nets",), (None,)], "text string"))
    assert len(tables) == quality.ORDER and all(len(t.inputFiles()) <= 4 for t in tables[2:])
    assert model[1].count() == 1 and 0 < model[1].first().spare < 1
    rows = [(k, "en" if k < 40 else None, k % 3 * 100 + 1, float(k)) for k in range(50)] + [(None, "en", 5, 1.0)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, _symbols long, _perplexity double")
    ids = spark.createDataFrame([(k,) for k in range(48)], "doc_id long")
    found = quality.limits(scored, ids, 1.0, 2.0, 8)
    assert {(r.lang, r["limit"]) for r in found.wide.collect()} == {("en", 78.0), (None, 94.0)}
    assert {r.lang for r in found.near.collect()} == {"en"} and found.every == 94.0
    assert quality.limits(scored, ids.where("false"), 1.0, 2.0, 8).every is None


def plain_model(texts):
    """Interpolated modified Kneser-Ney by the textbook, from dictionaries."""
    table, n = quality.symbols(), quality.ORDER
    grams = [Counter() for _ in range(n + 1)]
    for t in texts:
        s = [0] * (n - 1) + table[np.frombuffer((t or "").encode(), np.uint8)].tolist()
        grams[n].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        grams[k].update(g[1:] for g in grams[k + 1])

    def level(counts):
        spread = Counter(counts.values())
        n1, n2, n3, n4 = (spread[i] or 0.5 for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        off = [min(max(d, 0.05), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        total, spare = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            spare[g[:-1]] += off[min(c, 3) - 1]
        return counts, off, total, spare

    levels = [None, *(level(grams[k]) for k in range(1, n + 1))]

    def probability(gram):
        lower = probability(gram[1:]) if len(gram) > 1 else 1 / quality.SYMBOLS
        counts, off, total, spare = levels[len(gram)]
        context = gram[:-1]
        if not total[context]:
            return lower
        c = counts[gram]
        return (c - off[min(c, 3) - 1] if c else 0) / total[context] + spare[context] / total[context] * lower

    return probability


def test_kneser_ney_is_the_textbooks(spark, docs):
    trusted = docs.orderBy("n_chars").limit(60)
    texts = [r.text for r in trusted.collect()] + [None, ""]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    bits = quality.surprise(quality.train(table))
    probability = plain_model(texts)
    rng = np.random.default_rng(4)
    seen = quality.codes(pa.array(texts[:20]))[0]
    for code in [*rng.choice(seen, 150).tolist(), *rng.integers(0, len(bits), 150).tolist()]:
        gram = tuple(code >> (quality.BITS * k) & (quality.SYMBOLS - 1) for k in reversed(range(quality.ORDER)))
        assert np.exp(-bits[code]) == pytest.approx(probability(gram), rel=1e-4)
    context = int(seen[100]) >> quality.BITS << quality.BITS
    assert np.exp(-bits[context : context + quality.SYMBOLS]).sum() == pytest.approx(1, abs=1e-4)


def test_symbols_are_the_bytes():
    """Capitals, digits and accents are told apart: no two bytes share a symbol, and none is the start's."""
    assert sorted(quality.symbols().tolist()) == list(range(1, 257))
    assert len(set(quality.codes(pa.array(["AB12"]))[0] & (quality.SYMBOLS - 1))) == 4


def test_perplexity_is_the_textbooks(spark, monkeypatch):
    """Documents are scored by joins over several chunks, rows without doc_id and repeated ones included."""
    monkeypatch.setattr(quality, "CHUNK_BYTES", 300)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Alpha", "be", "12", "dé", "zz."]) for _ in range(rng.randint(1, 30))) for _ in range(30)]
    rows = [*enumerate(texts), (3, "another text 99"), (3, texts[3]), (None, "no id"), (None, texts[0]), (90, ""), (91, None), (92, "\0\1")]
    table = spark.createDataFrame([(*r, "en", n) for n, r in enumerate(rows)], "doc_id int, text string, lang string, at int")
    ids = [*range(12), 500]
    trusted = spark.createDataFrame([(i,) for i in [*ids, 3, None]], "doc_id long")
    dealt = quality.deal(table)[0]
    assert dealt.select("_chunk").distinct().count() > 3
    found = {r["at"]: r for r in quality.learn(table, trusted, keep_text=True)[1].collect()}
    assert len(found) == len(rows)
    probability = plain_model([t for i, t in rows if i in ids])
    for at, (i, text) in enumerate(rows):
        s = [0] * (quality.ORDER - 1) + [b + 1 for b in (text or "").encode()]
        bits = [-np.log(probability(tuple(s[k : k + quality.ORDER]))) for k in range(len(s) - quality.ORDER + 1)]
        assert (found[at].doc_id, found[at].text, found[at]._symbols) == (i, text, len(bits))
        assert found[at]._perplexity == pytest.approx(np.exp(np.mean(bits)) if bits else 1, rel=1e-4)


def test_chunks_are_small_however_few_buckets(spark):
    """A task holds one chunk at a time, so its text is bounded well below an executor's memory."""
    table = spark.range(24).selectExpr("id doc_id", "repeat('word ', 200000) text", "'en' lang")
    dealt, chunks = quality.deal(table)
    assert chunks == 3 and dealt.inputFiles()
    found = {r["_chunk"]: r["n"] for r in dealt.groupBy("_chunk").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert len(found) == 3 and max(found.values()) <= 16_000_000


def test_quality_on_held_out_labels(spark, docs, labels):
    """Trusted is what the labels of four fifths say; the rest is judged."""
    learn, held = labels.where(~toxicity.held_out()), labels.where(toxicity.held_out())
    rows = quality.classify(docs, learn.where("quality = 1")).join(held, "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    poor = [r.keep for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(poor) <= 0.25 * len(poor)


def test_quality_of_odd_rows(spark):
    odd = [(1, None, "en"), (2, "", None), (3, "good text of words " * 4000, "en"), (4, "%%%###" * 90, None), (None, "good text", "xx")]
    table = spark.createDataFrame([(*r, 1.0, "k") for r in odd], "doc_id long, text string, lang string, perplexity double, keep string")
    ids = spark.createDataFrame([(1,), (3,), (None,)], "doc_id long")
    rows = {r.doc_id: r for r in quality.classify(table, ids).collect()}
    assert len(rows) == 5 and rows[1].keep and rows[2].keep and rows[3].keep and not rows[4].keep
    assert all(r.keep and r.ceiling is None for r in quality.classify(table, ids.where("false")).collect())
    assert quality.classify(table.where("false"), ids).collect() == []


# --- similarity join ---


def plain_shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_join(texts, threshold=0.8):
    sets = {t: plain_shingles(t) for t in texts}
    links = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            links.add((a, b))
    return links


def near_copies(rng, n, words=120, changed=6):
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    made = []
    for _ in range(n):
        copy = list(base)
        for i in rng.integers(0, words, rng.integers(0, changed)):
            copy[i] = f"x{rng.integers(0, 999)}"
        made.append(" ".join(copy))
    return made


@pytest.mark.parametrize("block", [512, 16])
def test_join_finds_every_link(spark, docs, monkeypatch, block):
    monkeypatch.setattr(forest_join, "BLOCK_TEXTS", block)
    rng = np.random.default_rng(6)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("n_chars").limit(500).collect()]
    rows += [(5000 + i, t) for i, t in enumerate([*near_copies(rng, 90), *near_copies(rng, 40, 30, 2), "a b", "A, b!", "", None, "...", "!!!"])]
    rows += rows[-8:] + [(None, rows[0][1])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class_id string, n_links int")
    found = forest_join.join(table).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    texts = {}
    for i, t in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    copies = Counter(t or "" for _, t in rows)
    links = plain_join(texts)
    count, group = Counter(), {t: {t} for t in texts}
    for a, b in links:
        count[a] += 1
        count[b] += 1
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    by_id = {i: t or "" for i, t in rows if i is not None}
    wrong = 0
    for r in found:
        t = by_id.get(r.doc_id, rows[0][1])
        assert (r.text_id, r.copies) == (texts[t], copies[t])
        assert r.class_id == min(texts[x] for x in group[t])
        wrong += r.n_links != count[t]
    assert wrong <= 0.01 * len(found)  # the target recall is 0.999
    assert forest_join.join(table.where("false")).collect() == []


def test_prefixes_shorten_until_the_recall_is_met():
    assert forest_join.prefix_length(0.8, 14, 6, 0.999) == 4
    assert forest_join.prefix_length(0.8, 14, 6, 0.97) == 6
    assert forest_join.prefix_length(0.8, 2, 6, 0.9999) == 1


def test_shingles_and_minhash():
    texts = pa.array(["One two, three four FIVE six", None, "", "--", "a b", "a b", "x " * 70_000])
    values, begins = shingles.of_texts(texts, 5)
    sizes = np.diff(begins).tolist()
    assert sizes == [2, 0, 0, 0, 1, 1, 69_996]
    assert values[2] == values[3]
    rows = shingles.minhash(values, begins, 6)
    assert rows.shape == (4, 6) and (rows[1] == rows[2]).all()
    rng = np.random.default_rng(0)
    a = shingles.mix(rng.integers(0, 2**63, 3000).astype(np.uint64))
    pair = np.concatenate([a[:2000], a[500:2500]])  # Jaccard 0.6
    got = shingles.minhash(pair, np.array([0, 2000, 4000]), 2000)
    assert np.mean(got[0] == got[1]) == pytest.approx(0.6, abs=0.04)


# --- vectors ---


def test_index_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = permutation_index.usable(rows)
    found = permutation_index.search(vectors, vectors.where("vec_id % 20 = 0")).toPandas()
    table = vectors.orderBy("vec_id").toPandas()
    ids, matrix = table["vec_id"].to_numpy(), np.stack(table["embedding"])
    true = permutation_index.brute_force(ids, matrix, ids[ids % 20 == 0], 20)
    both = found.merge(true, on=["query_id", "vec_id"], suffixes=("", "_true"))
    assert len(found) == len(true) and len(both) >= 0.9 * len(true)
    assert np.allclose(both["score"], both["score_true"], rtol=1e-12)
    assert (found.groupby("query_id")["rank"].max() == 20).all()


def test_index_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(60)] + [(100 + i, [3.0, 3.0, 3.0]) for i in range(50)]
    bad = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 1.0]), (203, [nan, 1.0, 1.0]), (204, [inf, 1.0, 1.0]), (205, [1.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + bad + rows[:5]], "vec_id long, embedding array<float>, label int, score string")
    vectors = permutation_index.usable(table)
    assert sorted(r.vec_id for r in vectors.collect()) == sorted(i for i, _ in rows)
    found = permutation_index.search(vectors, vectors.where("vec_id % 20 = 0"), k=7).collect()
    matrix = dict(rows)
    for q in {r.query_id for r in found}:
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        best = sorted((-float(np.dot(matrix[q], v)), i) for i, v in rows if i != q)[:7]
        assert [(r.vec_id, -r.score) for r in mine] == [(i, s) for s, i in best]
    few = vectors.where("vec_id < 3")
    assert permutation_index.search(few, few, k=20).count() == 6
    assert permutation_index.search(vectors.where("false"), vectors).collect() == []


# --- pipeline ---


@pytest.fixture(scope="module")
def pipeline():
    sys.path.insert(0, ".")
    import corpus_pipeline

    return corpus_pipeline


def test_pipeline_stages_keep_clean_documents(spark, docs, labels, pipeline, tmp_path):
    kept, left = docs, {}
    for name, stage in pipeline.STAGES:
        result = stage(spark, kept, SF)
        result.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert kept.schema.simpleString() == docs.schema.simpleString()
            left[name] = {r.doc_id for r in kept.select("doc_id").collect()}
    marks = {r.doc_id: r for r in labels.collect()}
    english = {r.doc_id for r in docs.where("lang = 'en'").select("doc_id").collect()}
    toxic = {i for i, r in marks.items() if r.toxic and i in english}
    clean = {i for i, r in marks.items() if not r.toxic and r.quality}
    assert len(left["toxicity"] & toxic) <= 0.1 * len(toxic)
    assert clean <= left["toxicity"] and len(clean & left["quality"]) >= 0.99 * len(clean)
    texts = Counter(r.text for r in docs.where(docs.doc_id.isin(list(left["near_copies"]))).collect())
    assert max(texts.values()) == 1
    assert {r.doc_id for r in kept.select("doc_id").collect()} == left["near_copies"]


def test_pipeline_fetches_no_model(spark, pipeline, docs, monkeypatch):
    """The quality stage leaves counts, shares and spares in Spark tables: nothing is fetched whole or sent to every task."""

    def refuse(*_):
        raise AssertionError("fetched or sent whole")

    monkeypatch.setattr(type(docs), "toPandas", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    assert 0 < pipeline.drop_poor(spark, docs, SF).count() < docs.count()


def test_pipeline_of_odd_rows(spark, pipeline, docs):
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "text", "en", "s", 4), (10**6 + 2, "x" * 200_000, "en", "s", 1)]
    rows = docs.limit(50).union(spark.createDataFrame(odd, docs.schema))
    for _, stage in pipeline.STAGES:
        assert stage(spark, rows, SF).count() >= 1
        assert stage(spark, rows.where("false"), SF).count() == 0


def test_near_copies_of_a_repeated_doc_id(spark, pipeline, docs):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(words[::-1])
    near = " ".join([*words[:58], "other", "end"])
    rows = [(3, a), (7, a), (7, b), (7, b), (9, near), (11, "alone and short")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    kept = pipeline.drop_near_copies(spark, table, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(3, a), (7, b), (11, "alone and short")])


def test_url_filter_twin_follows_aliases(spark):
    import duckdb

    from abuse_lens.llm import queries

    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://m.net/1", link("http://b.com/de/1")), (2, "http://m.net/a/2?x", link("../1")), (3, "http://m.net/3", link("/1#y")),
        (4, "http://b.com/de/1", None), (5, "http://x.example.org/en/1", ""), (6, "http://m.net/6", link("//x.example.org/en/1")),
        (7, None, link("/1")), (8, "no", ""), (9, "http://m.net/9", link("http://y.example.org/fr/") + link("http://x.example.org/en/1")),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    columns = ["page_id", "host", "path", "rule", "verdict", "decided_by"]
    found = sorted(tuple(r) for r in url_filter.judge(table, rules).select(*columns).collect())
    con = duckdb.connect()
    con.register("pages", table.toPandas())
    twin = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE['op3_url_filter']})").fetchall())
    assert found == twin
    assert {r[0]: r[4] for r in found if r[5] == "alias"} == {1: "block", 3: "block", 6: "allow", 9: "allow"}


def test_queries_are_registered_and_twins_agree(spark):
    import __spark_entry__ as entry
    from check import canonical, connect

    names = set(entry.queries())
    assert {m[0] for n in names if (m := re.match(r"op\d+_", n))} == {f"op{i}_" for i in range(1, 14)} and "pipeline" in names
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            ours = entry.queries()[name](spark, SF).toPandas()
            assert canonical(ours) == canonical(connect(SF).execute(sql).fetch_df())


def test_slices_of_very_few_words_or_bytes():
    for n in range(4):
        text = " ".join("abc"[:n])
        assert [len(x) for x in shingles.of_texts(pa.array([text]), 5)] == [int(n > 0), 2]
        assert len(quality.codes(pa.array([text[:n]]))[0]) == len(text[:n])


def test_toxicity_sends_each_text_once_and_nothing_back_but_scores(spark):
    rows = [(1, "vile words", "en"), (2, None, None), (None, "good words", "en"), (2, "vile", "de"), (2, "vile", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.Model({"vile": 3.0, "good": -1.0}, -2.0)
    scored = toxicity.score(table, model, keep=table.columns)
    expected = [(*r, model.score(r[1]), int(model.score(r[1]) >= 0.5)) for r in rows]
    assert sorted(map(str, map(tuple, scored.collect()))) == sorted(map(str, expected))
    clean = scored.where("predicted = 0").select(*table.columns)
    assert sorted(map(str, map(tuple, clean.collect()))) == sorted(str(r) for r in rows if model.score(r[1]) < 0.5)
    for df in (scored, clean):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "MapIn" not in plan
