"""Order MinHash fingerprints: sketches of k-mers that keep their text order, so that likeness follows edit distance.

Every k-mer of a text is numbered by its occurrence (the first, the second ...),
which makes the k-mers a set.  Each of ``sketches`` hash functions selects the
``size`` smallest numbered k-mers; they are put back in text order, without
their numbers, and their tuple is hashed to 32 bits.  A fingerprint is the hex
form of these hashes, and the likeness of two is the share of places at which
they agree.  Moving a passage changes tuples even where the set of k-mers stays
the same, which a plain MinHash does not see.

:func:`edited_fingerprints` also compares each document with the next one by id:
rows are dealt by ranges of (id, hash of the text), whose cuts come from a
bounded sample and decide nothing but where rows go; each range ends with a copy
of the row that the next range begins with, so a task meets every pair of
neighbours while it reads its rows once, in order, holding two of them.

Defined results for odd input: a null text is empty; an empty text has the empty
fingerprint, which is like another empty one (1) and like no other (0); a text
shorter than ``k`` is its own k-mer, and one with fewer than ``size`` k-mers has
tuples of all; texts of any length are read whole (a task takes some 80 bytes
of memory for a code point of its longest text); rows without id come first;
rows of one id go by their text; equal rows follow each other; a single row is
its own next one; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.graph import bounded_batches, sized
from quarrylight.llm.textops import mix

K, SKETCHES, SIZE = 8, 64, 2
#: Positions that are hashed by all functions at a time.
BLOCK = 4096
#: Bytes of text of a range, and rows of the sample for each range.
RANGE_BYTES, SAMPLED = 64 << 20, 50
#: Hex digits of a sketch.
DIGITS = 8

_PLACE = mix(np.arange(1, 513, dtype=np.uint64)) | np.uint64(1)
_TIMES = _PLACE[-2]
_BASE = int(_PLACE[-3])
_FIRST = -(1 << 63)


def numbered_kmers(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each k-mer in text order, and one of each with its occurrence number."""
    k = min(k, len(points))
    n = len(points) - k + 1
    if not k:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    kmers = mix(_rolled(mix(points.astype(np.uint64) + np.uint64(1)), k))
    bits = np.uint64(n.bit_length())
    packed = (kmers >> bits << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    kind = packed >> bits
    repeated = np.flatnonzero(kind[1:] == kind[:-1]) + 1
    if not len(repeated):
        return kmers, kmers * _TIMES
    begins = np.flatnonzero(np.concatenate(([True], np.diff(repeated) > 1)))  # runs of one k-mer, without its first
    number = np.arange(1, len(repeated) + 1) - np.repeat(begins, np.diff(np.append(begins, len(repeated))))
    numbered = kmers.copy()
    numbered[(packed[repeated] - (kind[repeated] << bits)).astype(np.int64)] += number.astype(np.uint64) * _PLACE[-1]
    return kmers, numbered * _TIMES


def _rolled(values: np.ndarray, k: int) -> np.ndarray:
    """At each place, the next k values as the digits of one number (modulo 2**64), by doubling."""
    out, width = values, 1
    for bit in f"{k:b}"[1:]:
        out = out[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + out[width:]
        width *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(_BASE) + values[width:]
            width += 1
    return out


class OrderMinHash:
    """Fingerprints by a fixed family of hash functions."""

    def __init__(self, k: int = K, sketches: int = SKETCHES, size: int = SIZE):
        self.k, self.sketches, self.size = k, sketches, size
        family = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.times = ((family >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        self.rows = np.arange(sketches)[:, None]
        self.room = np.empty(sketches * BLOCK, np.uint32)

    def minima(self, values: np.ndarray) -> np.ndarray:
        """Per function, the positions of the smallest values in text order; ties go to the first."""
        every = np.arange(self.sketches)
        best = at = None
        for lo in range(0, len(values), BLOCK):
            part = values[lo : lo + BLOCK]
            hashed = self.room[: self.sketches * len(part)].reshape(self.sketches, len(part))
            np.multiply(part, self.times, out=hashed)
            found_at, found = [], []
            for _ in range(min(self.size, hashed.shape[1])):
                p = hashed.argmin(1)
                found_at.append(p + lo)
                found.append(hashed[every, p].astype(np.uint64))
                hashed[every, p] = 0xFFFFFFFF
            more, more_at = np.stack(found, 1), np.stack(found_at, 1)
            best, at = (more, more_at) if best is None else (np.concatenate((best, more), 1), np.concatenate((at, more_at), 1))
            if best.shape[1] > self.size:
                least = np.argsort(best, axis=1, kind="stable")[:, : self.size]
                best, at = best[self.rows, least], at[self.rows, least]
        return np.sort(at, axis=1)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """The sketches of a text given by its code points; none for an empty one."""
        kmers, numbered = numbered_kmers(points, self.k)
        if not len(kmers):
            return np.zeros(0, np.uint32)
        at = self.minima((numbered >> np.uint64(32)).astype(np.uint32))
        tuples = (kmers[at] * _PLACE[: at.shape[1]]).sum(axis=1, dtype=np.uint64)
        return (mix(tuples + _PLACE[at.shape[1]]) >> np.uint64(32)).astype(np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def as_hex(sketches: np.ndarray) -> str:
    return sketches.astype(">u4").tobytes().hex()


def alike(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) and len(b):
        return float((a == b).mean())
    return float(len(a) == len(b))


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches at which two fingerprint columns agree."""
    n = F.length(a) / DIGITS
    part = lambda c, i: F.substring(c, i * DIGITS + 1, F.lit(DIGITS))
    same = F.size(F.filter(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: part(a, i) == part(b, i)))
    return F.when((a != "") & (b != ""), same / n).otherwise((F.length(a) == F.length(b)).cast("double"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES, size: int = SIZE) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row, where it is read: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(k, sketches, size)
        for batch in batches:
            points = [code_points(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) for p in points], pa.int64()), pa.array([as_hex(sketch(p)) for p in points], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _range_of(cuts: list[tuple[int, int]]):
    """A function of ids and text hashes: how many cuts are at or before each."""
    cut_ids = np.array([c[0] for c in cuts], np.int64)
    cut_hashes = np.array([c[1] for c in cuts], np.int64)

    def count(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
        cut = np.flatnonzero(hi > lo)
        for first in np.unique(lo[cut]).tolist():  # ids that are cut, of which a batch has few
            own = cut[lo[cut] == first]
            last = hi[own[0]]
            lo[own] = first + np.searchsorted(cut_hashes[first:last], hashes[own], "right")
        return lo

    return count


def in_order(docs: DataFrame, id_col: str, text_col: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows in ranges of id and text, each sorted within one partition and ended by the row that comes next.

    Columns doc_id, text, last (true for the added row of a range), of which the
    order goes on at the first row after the last one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.lit(_FIRST))).withColumn("hash", F.xxhash64("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(1, min(n, max(sized(spark), -(-size // range_bytes))))
    sample = keyed.select("key", "hash").sample(min(1.0, SAMPLED * ranges / max(n, 1)), 1).collect() if ranges > 1 else []
    sample.sort()
    cuts = [tuple(sample[i * len(sample) // ranges]) for i in range(1, ranges)] if sample else []
    count = _range_of(sorted(set(cuts)))

    @F.pandas_udf("int")
    def range_of(key, hashed):
        import pandas as pd

        return pd.Series(count(key.to_numpy(), hashed.to_numpy()), dtype="int32")

    ranged = keyed.withColumn("range", range_of("key", "hash"))
    begins = ranged.groupBy("range").agg(F.min("key").alias("key"))  # a row for each range
    own = sorted(r["range"] for r in begins.select("range").collect())
    before = spark.createDataFrame([(r, own[i - 1]) for i, r in enumerate(own)], "range int, before int")
    heads = ranged.join(F.broadcast(begins), ["range", "key"], "left_semi").groupBy("range").agg(F.min("text").alias("text"))
    ends = heads.join(F.broadcast(before), "range").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("key"), F.col("before").alias("range"), F.lit(True).alias("last"))
    both = ranged.select("doc_id", "text", "key", "range", F.lit(False).alias("last")).unionByName(ends)
    return both.repartitionById(max(1, len(cuts) + 1), "range").sortWithinPartitions("range", "last", "key", "text").select("doc_id", "text", "last")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _neighbours(k: int, sketches: int, size: int):
    names = [c.split()[0] for c in EDITED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(k, sketches, size)
        held = None
        for batch in batches:
            out: list[tuple] = []
            for id_, text, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sketch(code_points(text))
                if held is not None:
                    held_id, held_text, held_own = held
                    changed = edited(held_text, text)
                    other = sketch(code_points(changed))
                    out.append((held_id, len(held_text), hashlib.sha256(changed.encode()).hexdigest(), as_hex(held_own), as_hex(other), alike(held_own, other), alike(held_own, own)))
                held = None if last else (id_, text, own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    return run


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES, size: int = SIZE) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that one and to the next document's."""
    bounded_batches(docs.sparkSession)
    return in_order(docs, id_col, text_col).mapInArrow(_neighbours(k, sketches, size), EDITED)


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
