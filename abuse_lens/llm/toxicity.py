"""Toxicity classifier with counterfactual regularisation (operator 4).

A logistic model of which words a text has, fitted on a bounded sample of
labelled rows.  Every identity term in a labelled sentence is swapped for the
other terms of its group, and for a neutral word, and the fit pays for every
change of the sentence's score.  So the mention of a group neither raises nor
lowers a score by itself, and what is left are the words around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abuse_lens.plans.settle import settle

# Terms that name groups of people; the last of each group is neutral.
IDENTITY = [
    ["women", "men", "girls", "boys", "people"],
    ["woman", "man", "girl", "boy", "person"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "believers"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "religious"],
    ["black", "white", "asian", "african", "latino", "arab", "european", "american", "local"],
    ["gay", "lesbian", "bisexual", "transgender", "queer", "straight", "married"],
    ["immigrants", "refugees", "migrants", "foreigners", "natives", "residents"],
    ["immigrant", "refugee", "migrant", "foreigner", "native", "resident"],
    ["disabled", "blind", "deaf", "elderly", "old", "young", "busy"],
]
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
#: Texts that a task turns into Python strings at once.
BATCH_TEXTS = 500


@dataclass(frozen=True)
class Settings:
    per_class: int = 8000  #: labelled rows of each class that the fit may use, the same ones for the same input
    vocabulary: int = 4096  #: words with a weight of their own, besides identity terms
    ridge: float = 1e-4
    counterfactual: float = 1.0  #: price of the mean squared change of a sentence's score under a swap
    steps: int = 400


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(get(w, 0.0) for w in words(text))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swaps(sentence: set[str]) -> list[set[str]]:
    """The sentence's words with one identity term replaced, for every other term of its group."""
    found = []
    for group in IDENTITY:
        for term in group:
            if term in sentence:
                found += [(sentence - {term}) | {other} for other in group if other != term]
    return found


def fit_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text and toxic of at most ``per_class`` labelled documents of each class, chosen by a hash of doc_id.

    A doc_id that is labelled more than once takes the higher label, one that has more
    than one text the least of them.  The choice has at most 2 x ``per_class``
    rows, so it is broadcast and the documents stay where they are.
    """
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = marks.where("toxic = 1").orderBy(order, "doc_id").limit(per_class).union(
        marks.where("toxic = 0").orderBy(order, "doc_id").limit(per_class)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(settle(chosen)), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("toxic").alias("toxic"))


def _logistic(cells, labels, pairs, size: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps on the whole sample; all of bounded size."""
    n, m = len(labels), len(set(pairs[0].tolist()))
    # the bias is a word that every row has
    row = np.concatenate([cells[0], np.arange(n)])
    col = np.concatenate([cells[1], np.full(n, size)])
    pair, pair_col, sign = pairs
    price = np.full(size + 1, settings.ridge)
    price[size] = 0
    # rare words get large steps
    scale = 1 / np.sqrt((np.bincount(col, minlength=size + 1) + 1) / n)

    def curved(v: np.ndarray, weight) -> np.ndarray:
        """The penalties' gradient at ``v``, and that of rows with these weights (or errors, if a function)."""
        z = np.bincount(row, v[col], minlength=n)
        found = np.bincount(col, weight(z)[row], minlength=size + 1) / n + price * v
        if m:
            change = np.bincount(pair, v[pair_col] * sign, minlength=m)
            found += settings.counterfactual * np.bincount(pair_col, change[pair] * sign, minlength=size + 1) / m
        return found

    # the largest curvature bounds the step
    v = np.ones(size + 1)
    largest = 1.0
    for _ in range(30):
        v = scale * curved(v, lambda z: 0.25 * z)
        largest = float(np.linalg.norm(v))
        v /= largest
    step = scale / (1.2 * largest)
    w = np.zeros(size + 1)
    w[size] = np.log((labels.sum() + 1) / (n - labels.sum() + 1))
    v = w.copy()
    for t in range(settings.steps):
        new = v - step * curved(v, lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:size], float(w[size])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``; labels other than 0 and 1 are left out.

    Without rows of both classes every text gets the share of the class there is
    (0.5 if there is none).  Words are chosen, and their counts made, on Spark; the
    driver gets at most 2 x ``per_class`` rows of word numbers.
    """
    # many small parts: reading a text takes longer than its size tells
    sample = settle(fit_sample(docs, labels, settings.per_class).repartition(64, "doc_id"))
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    n = positive + negative
    if not positive or not negative:
        return Model({}, float(np.log((positive + 0.5) / (negative + 0.5))))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "words": [list(words(t)) for t in batch["text"]]})

    per_row = sample.select("text", "toxic").mapInPandas(split, "toxic int, words array<string>")
    counts = per_row.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    # chi-squared of word and class; a word must stand out among all the words tried
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    both = (a + b) * (n - a - b) + 1e-9
    chi = n * (a * (negative - b) - b * (positive - a)) ** 2 / (both * positive * negative)
    tried = settle(counts.withColumn("chi", chi).where("a + b >= 2"))
    bar = 2 * np.log(max(2, tried.count()))
    rows = tried.where(F.col("chi") >= bar).orderBy(F.desc("chi"), "word").limit(settings.vocabulary).collect()
    names = sorted({r.word for r in rows} | {t for group in IDENTITY for t in group})
    number = {w: i for i, w in enumerate(names)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, pairs = [], []
            for text in batch["text"]:
                found.append(sorted(number[w] for w in words(text) if w in number))
                mine = []
                for sentence in SENTENCE.split(text or ""):
                    before = words(sentence)
                    for after in swaps(before):
                        mine.append([number[w] + 1 for w in before - after] + [-number[w] - 1 for w in after - before])
                pairs.append(mine)
            yield pd.DataFrame({"toxic": batch["toxic"], "found": found, "pairs": pairs})

    got = sample.select("text", "toxic").mapInPandas(
        encode, "toxic int, found array<int>, pairs array<array<int>>"
    ).collect()
    labels = np.array([r.toxic for r in got], np.float64)
    row = np.repeat(np.arange(len(got)), [len(r.found) for r in got])
    col = np.array([i for r in got for i in r.found], np.int64)
    pairs = [p for r in got for p in r.pairs if p]
    pair = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs]) if pairs else np.zeros(0, np.int64)
    signed = np.array([i for p in pairs for i in p], np.int64)
    cells, changed = (row.astype(np.int64), col), (pair, np.abs(signed) - 1, np.sign(signed).astype(float))
    weights, bias = _logistic(cells, labels, changed, len(names), settings)
    return Model({w: float(weights[i]) for w, i in number.items() if weights[i]}, float(bias))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), score and predicted for every row's whole text.

    Null and empty texts are scored as without words.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by Settings.vocabulary

    # other columns don't pass through Python; a filter on the result must not score texts again
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(a, BATCH_TEXTS).to_pylist() for a in range(0, len(texts), BATCH_TEXTS))
        return pa.array([shared.value.score(t) for part in parts for t in part], pa.float64())

    found = docs.select(*keep, scored.asNondeterministic()("text").alias("_score"))
    return found.select(
        *keep, F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")
    )


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that a model may learn from."""
    return labels.where(~held_out())


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
