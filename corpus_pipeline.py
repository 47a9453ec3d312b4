"""A corpus pipeline of four stages: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of documents. Rows with a null doc_id are scored, kept and packed like others. Rows of one doc_id
with the same words are one document, of which the second stage keeps the smallest text; rows of one doc_id
with other words are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import ngram_join, packing, quality, substring_dedup
from evidra.llm.common import stored

VOCABULARY = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; its scores are of the whole text."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words and more that one with a smaller doc_id has."""
    kept = substring_dedup.remove_repeats(docs, whole=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in training sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=False)


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_each_group), ("substring dedup", without_repeats), ("best-fit packing", packed)]

#: A trained model, components and packing are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
