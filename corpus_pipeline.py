"""The corpus pipeline: what is toxic, poor or a near copy goes, and the rest is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
has kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abuse_lens.llm import forest_join, packing, quality, toxicity
from abuse_lens.llm.common import read
from abuse_lens.llm.queries import CAPACITY, END_ID
from abuse_lens.plans.settle import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 4 does not predict to be toxic."""
    model = toxicity.fit(docs, toxicity.learnable(read(spark, sf_dir, "labels")))
    toxic = toxicity.score(docs, model, keep=docs.columns)
    return toxic.where("predicted = 0").select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity operator 2 finds usual for trusted text of their language."""
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    limits, scored = quality.learn(docs, trusted, keep_text=True)
    return quality.judge(scored, limits).where("keep").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal and near texts (operator 8) the document with the smallest doc_id."""
    key = F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    found = forest_join.join(docs, keep_key=True).where("doc_id <> class_id")
    found = found.select("doc_id", F.col("text_key").alias("_text_key")).distinct().hint("shuffle_hash")
    # a doc_id may be repeated with another text, which is judged on its own; a repeated row is an equal text too
    kept = docs.withColumn("_text_key", key).join(found, ["doc_id", "_text_key"], "left_anti")
    return kept.dropDuplicates(["doc_id", "_text_key"]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes (operator 7)."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]
#: No SQL twin: the classifier, the language model, the forest and the packing search are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
