"""The registered queries of this folder, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abuse_lens.llm import (
    byte_bpe,
    forest_join,
    hard_negatives,
    licences,
    packing,
    periodic_runs,
    permutation_index,
    quality,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
    winnowing,
)
from abuse_lens.llm.common import let, read, sql_text
from abuse_lens.plans.settle import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: (host, path, action) of the url rules.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
CAPACITY, END_ID = 4096, 1


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(read(spark, sf_dir, "pages"), rules)


@query
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer, CAPACITY, END_ID)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lengths = token_counts.with_lengths(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return token_counts.suffix_sums(token_counts.histogram(lengths))


@query
def op8_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_join.join(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query
def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = permutation_index.usable(read(spark, sf_dir, "embeddings"))
    return permutation_index.search(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(read(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    return quality.classify(read(spark, sf_dir, "documents"), trusted)


@query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edits(read(spark, sf_dir, "documents"))


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = byte_bpe.Vocabulary.load(path, public_tokenizers.PATTERN)
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary)


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s.length)
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", with_planted_runs().alias("text"))
    found = periodic_runs.collapse(docs)
    first = F.col("first")
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    return found.withColumn("first", periodic_runs.longest(F.col("_runs"))).select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        first.start.alias("start"),
        first.length.alias("length"),
        first.period.alias("period"),
        F.expr("1000 * first.length div first.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("_runs", line)).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs() -> Column:
    """The text; in one of ten documents, by the checksum of doc_id, made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def periodic(row: Column) -> Column:
        n, words = F.size(row.words).cast("long"), row.words
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))))

    planted = let(F.struct(words.alias("words")), lambda row: F.when(F.size(row.words) > 0, periodic(row)).otherwise(F.col("text")))
    return F.when(h % 10 == 0, planted).otherwise(F.col("text"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = settle(hard_negatives.quantised(rows.select("vec_id", moved.alias("label"), "embedding")))
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"))


def _host(url: str) -> str:
    found = f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)"
    return f"coalesce(translate({found}, {sql_text(url_filter.UPPER)}, {sql_text(url_filter.LOWER)}), '')"


def _address(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN {_host(url)} || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _best_rule(source: str, key: str) -> str:
    return f"""SELECT {key} AS key, r.host || r.path AS rule, action FROM (SELECT DISTINCT {key}, host, path FROM {source}) x
    JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path)
    QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, action = 'allow' DESC) = 1"""


_LINKS = ", ".join(
    f"list_transform(regexp_extract_all(html, {sql_text(tag)}), lambda x: regexp_extract(x, {sql_text(target)}, 1))"
    for tag, target in ((url_filter.LINK, url_filter.HREF), (url_filter.META, url_filter.REFRESH))
)
ORACLE["op3_url_filter"] = f"""WITH RECURSIVE rules(host, path, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
links AS (SELECT url, unnest(list_concat({_LINKS})) AS target FROM pages WHERE contains(url, '://')),
full_links AS (SELECT url, CASE WHEN contains(target, '://') THEN target
  WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || target
  WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
  WHEN starts_with(target, '#') THEN url
  ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)
    || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*((?:/[^?#]*)?/)[^/?#]*', 1), ''), '/') || target END AS target
  FROM links WHERE target <> ''),
edges AS (SELECT {_address("url")} AS u, {_address("target")} AS v FROM full_links),
ways AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach(a, b) AS (SELECT u, v FROM ways UNION SELECT reach.a, ways.v FROM reach JOIN ways ON reach.b = ways.u),
members AS (SELECT a AS address, least(a, min(b)) AS component FROM reach GROUP BY a),
places AS (SELECT address, {_host("'a://' || address")} AS host, {_path("'a://' || address")} AS path FROM members),
ruled AS ({_best_rule("places", "address")}),
verdicts AS (SELECT component, CASE WHEN bool_or(action = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM members JOIN ruled ON address = key GROUP BY component),
aliases AS (SELECT address, verdict FROM members JOIN verdicts USING (component)),
named AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_address("url")} AS address FROM pages),
keyed AS (SELECT *, host || ' ' || path AS place FROM named),
hits AS ({_best_rule("keyed", "place")})
SELECT page_id, host, path, rule, coalesce(action, verdict, 'allow') AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM keyed LEFT JOIN hits ON place = key LEFT JOIN aliases USING (address)"""

ORACLE["op13_hard_negatives"] = """WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 10"""

ORACLE["op11_suffix_dedup"] = """WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT r, doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM texts),
starts AS (SELECT r, h, unnest(range(n - 199)) AS pos FROM bytes WHERE n >= 200),
strings AS (SELECT r, pos, md5_number(substr(h, 2 * pos + 1, 400)) AS string FROM starts),
often AS (SELECT string FROM strings GROUP BY string HAVING count(*) > 1),
hits AS (SELECT r, pos FROM strings JOIN often USING (string)),
marked AS (SELECT *, pos > lag(pos + 200) OVER (PARTITION BY r ORDER BY pos) AS gap FROM hits),
numbered AS (SELECT *, sum(coalesce(gap, true)::INTEGER) OVER (PARTITION BY r ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (SELECT r, min(pos) AS a, max(pos) + 200 AS b FROM numbered GROUP BY r, span),
ends AS (SELECT r, 0 AS a, 0 AS b FROM bytes UNION ALL SELECT r, a, b FROM spans UNION ALL SELECT r, n, n FROM bytes),
kept AS (SELECT r, a, substr(h, 2 * lag(b) OVER w + 1, 2 * (a - lag(b) OVER w)) AS part
  FROM ends JOIN bytes USING (r) WINDOW w AS (PARTITION BY r ORDER BY a, b)),
left_over AS (SELECT r, coalesce(string_agg(part, '' ORDER BY a), '') AS h FROM kept GROUP BY r),
counted AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(left_over.h)) AS kept_sha256
FROM bytes LEFT JOIN counted USING (r) JOIN left_over USING (r)"""
