"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's documents form blocks.  In an ideal mix every source that has
blocks left gets, all the time, its weight's share of all weights left.  Block j
(from 1) of a source is released at the slot in which its ideal share begins and
due when that ends; earliest-deadline-first over the released blocks gives every
source, after any number of slots, less than one block more or less than its
ideal share.  When a source has no blocks left, the others keep their ratios, so
every document gets a slot.

The weights are taken exactly, as the fractions that their floats are, and every
block is scheduled, so the deviation stays below one block however long the mix
is.  The schedule is a sequence: one task deals it out, from one row a source to
one row a block, holding one block a source at a time.

Defined results for odd input: a null source is the source ''; a source without
a target weight gets weight by the square root of its documents; sources of
weight 0 or less follow after all others; documents of a source are ordered by
the hash of their id, then id, and repeated rows each get a place; an empty
table gives an empty result; only the id and source columns are read.  A weight
that isn't finite is an error.  There may be any number of sources.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 16
BUCKETS = 1024
#: Rows of the schedule that a task sends at once.
SENT = 1 << 16


def integer_weights(documents: dict[str, int], targets: dict[str, float] | None) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights."""
    targets = targets or {}
    share = {s: max(Fraction(float(targets.get(s, math.sqrt(n)))), Fraction(0)) for s, n in documents.items()}
    scale = math.lcm(*(x.denominator for x in share.values()))
    return {s: x.numerator * (scale // x.denominator) for s, x in share.items()}


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of every block, by slot; blocks count from 0."""
    some = {s: n for s, n in blocks.items() if weights[s] > 0}
    none = {s: n for s, n in blocks.items() if weights[s] <= 0}
    yield from _fair(some, weights, 0)
    yield from _fair(none, integer_weights(none, None), sum(some.values()))


def _fair(blocks: dict[str, int], weights: dict[str, int], start: int) -> Iterator[tuple[str, int, int, int, int]]:
    """The schedule of sources with weights above 0, from slot ``start``.

    A source has had j ideal blocks at the virtual time j / weight.  By that
    time v, all sources together have had sum(min(weight * v, blocks)) slots.
    """
    names = sorted(blocks)
    ends = sorted((Fraction(blocks[s], weights[s]), blocks[s], weights[s]) for s in names)
    near = [float(e) for e, _, _ in ends]
    over = list(accumulate((n for _, n, _ in ends), initial=0))
    total = sum(w for _, _, w in ends)
    left = [total - w for w in accumulate((w for _, _, w in ends), initial=0)]

    def slots(j: int, w: int) -> tuple[int, int]:
        k = bisect_left(near, j / w)
        while k and ends[k - 1][1] * w > j * ends[k - 1][2]:
            k -= 1
        while k < len(ends) and ends[k][1] * w < j * ends[k][2]:
            k += 1
        return divmod(over[k] * w + left[k] * j, w)

    waiting = [(0, i, 1) for i in range(len(names))]  # release, source, block
    ready: list[tuple[int, int, int, int, int]] = []
    for slot in range(over[-1]):
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            whole, rest = slots(j, weights[names[i]])
            heapq.heappush(ready, (whole + (rest > 0), i, j, release, whole))
        deadline, i, j, release, whole = heapq.heappop(ready)
        yield names[i], j - 1, start + slot, start + release, start + deadline
        if j < blocks[names[i]]:
            heapq.heappush(waiting, (whole, i, j + 1))


def period_slots(weights: dict[str, int]) -> dict[str, list[int]]:
    """For each source with as many blocks as its weight, their slots."""
    place: dict[str, list[int]] = {s: [] for s in weights}
    for s, _, slot, _, _ in schedule(weights, weights):
        place[s].append(slot)
    return place


def _dealt(targets: dict[str, float] | None, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {s: n for b in batches for s, n in zip(b["source"].to_pylist(), b["n"].to_pylist(), strict=True)}
        rows = schedule({s: -(-n // block_docs) for s, n in sizes.items()}, integer_weights(sizes, targets))
        while some := list(islice(rows, SENT)):
            columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), [pa.string()] + [pa.int64()] * 4, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["source", "block", "slot", "release", "deadline"])

    return run


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: its source, block, slot in the mix, place in the block, release and deadline."""
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    hashed = slim.withColumn("_h", F.xxhash64("_id")).withColumn("_bucket", F.pmod("_h", F.lit(buckets)).cast("int")).persist()
    sizes = hashed.groupBy("source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # a place within (source, bucket), plus what lies in the buckets before
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "_id")
    ranked = hashed.withColumn("_in", F.row_number().over(inside) - 1).join(offsets.drop("_n"), ["source", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    totals = sizes.groupBy("source").agg(F.sum("_n").alias("n"))
    placed = totals.repartition(1).mapInArrow(_dealt(targets, block_docs), "source string, block long, slot long, release long, deadline long")
    blocks = ranked.withColumn("block", F.floor(F.col("_rank") / block_docs).cast("long"))
    return blocks.join(placed, ["source", "block"]).select(
        F.col("_id").alias(id_col),
        "source",
        "block",
        "slot",
        (F.col("_rank") % block_docs).cast("long").alias("place"),
        "release",
        "deadline",
    )


def interleave(docs: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents, whole, in the order of the mix: each partition is a run of slots.

    Rows that agree in every column, which the mix counts once, lie together.
    """
    key = F.xxhash64(*docs.columns).alias("__mix_key")
    once = docs.select(key, F.col(source_col)).groupBy("__mix_key").agg(F.min(source_col).alias(source_col))
    order = mix_sources(once, targets, "__mix_key", source_col).select("__mix_key", F.col("slot").alias("__mix_slot"), F.col("place").alias("__mix_place"))
    joined = docs.select("*", key).join(order, "__mix_key")
    return joined.repartitionByRange("__mix_slot", "__mix_place").sortWithinPartitions("__mix_slot", "__mix_place").select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
