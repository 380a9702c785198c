"""Importance resampling towards a target distribution, in two Arrow passes.

Features are the single terms and the pairs of consecutive terms of a text,
hashed into buckets.  The first pass makes one vector of bucket counts for each
partition (``np.bincount``), and a ``treeReduce`` merges the vectors.  They give
each bucket a gain, the scaled logarithm of how much more often the target has
it than the source, both smoothed by one.  The second pass gathers the broadcast
gains (a vector of fixed length) by bucket and sums them per document with
``bincount`` weights.  A Gumbel number made from the document's id is added to
its mean gain, so the highest scores are a draw without replacement, and the
draw needs one sort of narrow rows, dealt by range.

Defined results for odd input: a null or empty text has no feature and weight 0;
texts of any length are read whole; equal scores go to the smaller id, rows
without id last; rows that repeat an id are scored and ranked each, in any order
among themselves; rows without id draw their number from the empty id; an empty
target has uniform smoothed counts; an empty table gives an empty result; only
the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.graph import bounded_batches, checkpoint, sized
from quarrylight.llm.terms import Terms, bigram_crc32, crc32
from quarrylight.llm.textops import chunks

BUCKETS = 10000
PERCENT, SEED, LEAST_WORDS = 25, 7, 20
SCORED = "doc_id long, n_words long, n_features long, weight long"


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature, and the terms of each row."""
    terms = Terms(texts)
    single = crc32(terms.bytes, terms.starts, terms.ends)
    pair_row, pair = bigram_crc32(terms, single)
    return np.concatenate((terms.row, pair_row)), (np.concatenate((single, pair)) % np.uint32(buckets)).astype(np.int64), terms.counts


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in chunks(texts):
                total += np.bincount(features(texts.slice(lo, hi - lo), buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    vectors = texts.select(text_col).mapInArrow(_counts(buckets), "counts binary").rdd.map(lambda row: np.frombuffer(row["counts"], np.int64))
    nothing = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.union(nothing).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln(share in the target / share in the source)), smoothed."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(gain, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for lo, hi in chunks(texts):
                row, bucket, words = features(texts.slice(lo, hi - lo), buckets)
                n = np.bincount(row, minlength=hi - lo)
                sums = np.bincount(row, gain.value[bucket], minlength=hi - lo).astype(np.int64)  # whole numbers below 2**53 are exact
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(words), pa.array(n), pa.array(sums // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets)))
    weighed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_weights(gain, buckets), SCORED)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row's scores, and the rank of those that are drawn; others have none.

    Of the rows with ``least_words`` terms, ``percent`` of 100 are drawn.
    """
    scored = checkpoint(scores(docs, target, id_col, text_col, buckets, seed).withColumn("may", F.col("n_words") >= least_words).withColumn("row", F.monotonically_increasing_id()))
    drawn = scored.filter("may").count() * percent // 100
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), "row"]
    place = F.monotonically_increasing_id()
    dealt = scored.repartitionByRange(sized(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND((1 << 33) - 1))
    dealt = checkpoint(dealt)  # what is dealt by a sampled range must not be dealt anew
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at") + 1
    return dealt.join(F.broadcast(before), "part").select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(documents, benchmark)
