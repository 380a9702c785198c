"""Corpus pipeline: classify, apply rules, drop near duplicates, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of ``documents``.  Every row is
judged by itself, whether its id is null, repeated or its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import classifier, mixing, ngram_join, packing, quality_rules
from quarrylight.llm.graph import checkpoint


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return classifier.accepted(docs, labels)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest id of each group of near duplicates."""
    return ngram_join.without_copies(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows, laid out in the order of the mix."""
    return mixing.interleave(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram Jaccard join", dedupe),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: The classifier and the tokenizer are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
