"""Checkpoints and connected components shared by the operators."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def checkpoint(df: DataFrame, cached: bool = True) -> DataFrame:
    """Cuts lineage with files in the folder that ``spark.checkpoint.dir`` names.

    Where the setting is missing, a folder of our own serves a local master, as
    in tests; on a cluster, where executors couldn't read it, that is an error.
    Spark computes the frame once, as it writes the files.  A cache on the way costs a
    job, but tells Spark the frame's true size, so that it may broadcast a small one.
    The shuffle files that led here go when the driver's garbage does, so that
    is collected at once: otherwise they stay until its heap happens to fill.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    held = df.persist() if cached else df
    out = held.checkpoint()
    if cached:
        held.unpersist(True)
    del df, held
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def written(df: DataFrame) -> DataFrame:
    """A checkpoint without the cache."""
    return checkpoint(df, cached=False)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay the same,
    which takes about the logarithm of the longest path; each step is one
    aggregation and one join on the node, so no node's neighbours meet in one row.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = _fingerprint(edges)
    while before[0]:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # every u has a row in large, so its edge to m needs no pass of its own
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(low, "u").select(F.inline(ends)).filter("u <> v").distinct()
        edges = written(small)
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches end at BATCH_BYTES, unless the session has a bound of its own.

    A worker holds a batch of texts several times over while it works on it, and
    the JVM holds it beside its heap.
    """
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, BATCH_BYTES)


def sized(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
