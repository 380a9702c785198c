"""Stupid-backoff language-model scores against the corpus itself.

Count tables of word n-grams are partitioned by ranges of hashes.  Documents are
dealt to blocks in compressed pieces; a block explodes its texts into n-grams and sends its distinct ones,
with their counts, to the parts of the table; a part adds up the counts of all
blocks and answers each block for the n-grams it sent; the block joins the
answers to its n-grams and sums the scores of each document.  So the exchange
is that of a count, a join and a sum, but a row holds all n-grams that a block
and a part have in common, packed: a frequent n-gram is one entry per block.

The score of a word is the first that applies of c(w1 w2 w3) / c(w1 w2), then
0.4 c(w2 w3) / c(w2), then 0.16 c(w3) / N, and 0.4**k / N for a word never
seen; ``order`` says how long the longest n-gram is.  With ``leave_out`` a
document's own n-grams are taken off the counts, so none is scored by itself.
All counts are over all documents; n-grams are 64-bit hashes.

Words are runs of characters other than space and U+0009 to U+000D, with A-Z
lower-cased.  Defined results for odd input: a null or wordless text has 0
words, a sum of 0 and no mean; repeated rows and ids are documents each; a very
long text is read whole, in a block of its own; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import textops
from quarrylight.llm.graph import bounded_batches

BACKOFF = 0.4
#: Text of a block; a worker holds its n-grams, some 12 times as much.
BLOCK_BYTES = 8 << 20
#: Text of a piece that is compressed and dealt to a block as one.
PIECE_BYTES = 128 << 10


def _grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each length the hash of the n-gram that ends at each word (0 where none does), the words' rows, and words per row."""
    hashes, rows, counts = [], [], []
    for lo, hi in textops.chunks(texts):
        words = textops.Words(texts.slice(lo, hi - lo))
        hashes.append(words.hashes())
        rows.append(words.row + lo)
        counts.append(words.counts)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    h, row, per = join(hashes, np.uint64), join(rows, np.int64), join(counts, np.int64)
    place = np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per)
    grams = []
    for n in range(1, order + 1):
        g = np.full(len(h), n, np.uint64)
        for k in range(n):
            g[n - 1 :] += h[n - 1 - k : len(h) - k] * textops._SEQUENCE[k]
        g = textops.mix(g) | np.uint64(1)
        g[place < n - 1] = 0
        grams.append(g)
    return grams, row, per


def _distinct(grams: list[np.ndarray], n_parts: int) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Sorted distinct n-grams of a block, their counts, and which of them each part gets: those of a range of hashes."""
    every = np.concatenate(grams)
    keys, counts = np.unique(every[every != 0], return_counts=True)
    parts = (keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
    cuts = np.searchsorted(parts, np.arange(n_parts + 1, dtype=np.uint64)).tolist()
    return keys, counts, [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_HEAD = np.dtype([("n", "<u4"), ("steps", "<u4"), ("first", "<u8"), ("low", "u1"), ("odd", "u1")])


def _packed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys, less the first: their low bits as they are, as many as gaps have on average, and the high bits as steps from key to key, one bit each."""
    n, odd = len(keys), int((keys & np.uint64(1)).all())
    if not n:
        return np.zeros(1, _HEAD).tobytes()
    above = keys - keys[0] >> np.uint64(odd)  # the lowest bit of odd keys says nothing
    low = max(int(above[-1]) // n, 1).bit_length() - 1
    high = (above >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1, np.uint8)
    bits[high] = 1
    whole, rest = divmod(low, 8)
    parts = [np.array([(n, len(bits), keys[0], low, odd)], _HEAD).tobytes(), np.packbits(bits).tobytes(), above.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :whole].tobytes()]
    if rest:
        last = (above >> np.uint64(8 * whole)).astype(np.uint8)
        parts.append(np.packbits(np.unpackbits(last[:, None], axis=1, count=rest, bitorder="little")).tobytes())
    return b"".join(parts)


def _unpacked(data: bytes) -> np.ndarray:
    n, steps, first, low, odd = np.frombuffer(data, _HEAD, 1)[0].tolist()
    at = _HEAD.itemsize
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -(-steps // 8), at), count=steps)) - np.arange(n)
    at += -(-steps // 8)
    whole, rest = divmod(low, 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :whole] = np.frombuffer(data, np.uint8, n * whole, at).reshape(n, whole)
    if rest:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-n * rest // 8), at + n * whole), count=n * rest)
        out[:, whole] = np.packbits(bits.reshape(n, rest), axis=1, bitorder="little").ravel()
    above = out.view("<u8").ravel() | high.astype(np.uint64) << np.uint64(low)
    return (above << np.uint64(odd)) + np.uint64(first)


def _small(counts: np.ndarray) -> bytes:
    """Counts of 1 or more: a bit tells whether there is more than 1, a byte how many, and eight where that is too few."""
    more = counts[counts > 1]
    wide = more[more > 254]
    return b"".join((np.array([len(counts), len(more)], "<u4").tobytes(), np.packbits(counts > 1).tobytes(), np.minimum(more, 255).astype(np.uint8).tobytes(), wide.astype("<i8").tobytes()))


def _large(data: bytes) -> np.ndarray:
    n, n_more = np.frombuffer(data, "<u4", 2).tolist()
    at = 8 + -(-n // 8)
    out = np.ones(n, np.int64)
    more = np.frombuffer(data, np.uint8, n_more, at).astype(np.int64)
    more[more == 255] = np.frombuffer(data, "<i8", -1, at + n_more) if len(data) > at + n_more else []
    out[np.unpackbits(np.frombuffer(data, np.uint8, at - 8, 8), count=n).astype(bool)] = more
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in textops.chunks(batch.column(0)):
            words = textops.Words(batch.column(0).slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array([len(words.starts)], pa.int64()), pa.array([len(words.bytes)], pa.int64())], ["n", "size"])


def _pieces(n_blocks: int, most: int):
    """Runs of a task's documents with about ``most`` bytes of text, compressed, dealt to the blocks in turn from a place of the task's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = int(TaskContext.get().partitionId() * 0.6180339887498949 % 1 * n_blocks)
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])
                at = (at + 1) % n_blocks

    return run


def _sorted(block: pa.Table) -> pa.Table:
    """A block's rows in an order that doesn't depend on how its pieces arrived."""
    rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in block["data"]])
    return rows.sort_by([("id", "ascending"), ("text", "ascending")])


def _send(order: int, n_parts: int):
    def run(block: pa.Table) -> pa.Table:
        number = block["block"][0].as_py()
        block = _sorted(block)
        grams, _, _ = _grams(block["text"].combine_chunks(), order)
        keys, counts, parts = _distinct(grams, n_parts)
        parts_used = [p for p, own in enumerate(parts) if own.stop > own.start]
        return pa.table(
            {
                "part": pa.array(parts_used, pa.int32()),
                "block": pa.array([number] * len(parts_used), pa.int32()),
                "keys": pa.array([_packed(keys[parts[p]]) for p in parts_used], pa.binary()),
                "counts": pa.array([_small(counts[parts[p]]) for p in parts_used], pa.binary()),
            }
        )

    return run


def _answer(part: pa.Table) -> pa.Table:
    """Adds up a part's counts over all blocks and gives each block those of its keys."""
    sent = [_unpacked(k) for k in part["keys"].to_pylist()]
    sizes = np.array([len(k) for k in sent])
    flat = np.concatenate(sent)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    group = np.cumsum(new) - 1
    counts = np.concatenate([_large(c) for c in part["counts"].to_pylist()])[order]
    total = np.add.reduceat(counts, np.flatnonzero(new))
    answer = np.empty(len(flat), np.int64)
    answer[order] = total[group]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return pa.table({"block": part["block"], "part": part["part"], "counts": pa.array([_small(answer[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _score(order: int, n_parts: int, leave_out: bool, total: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        block = _sorted(block)
        grams, row, per = _grams(block["text"].combine_chunks(), order)
        keys, _, parts = _distinct(grams, n_parts)
        counts = np.zeros(len(keys), np.int64)
        given = dict(zip(answers["part"].to_pylist(), answers["counts"].to_pylist(), strict=True))
        for p, own in enumerate(parts):
            if own.stop > own.start:
                counts[own] = _large(given[p])
        n = total - (per[row] if leave_out else 0)
        seen = [_corpus_counts(g, row, keys, counts, leave_out) for g in grams]
        scores = np.full(len(row), np.nan)
        for k in range(order, 1, -1):
            context = np.zeros(len(row), np.int64)
            context[1:] = seen[k - 2][:-1]
            if leave_out:
                context = np.maximum(context, seen[k - 1])
            use = np.isnan(scores) & (grams[k - 1] != 0) & (seen[k - 1] > 0)
            scores[use] = BACKOFF ** (order - k) * seen[k - 1][use] / context[use]
        use = np.isnan(scores)
        floor = BACKOFF ** (order - 1) * np.maximum(seen[0], 1) / np.maximum(n, 1)
        scores[use] = floor[use] if np.ndim(floor) else floor
        summed = np.bincount(row, np.log(scores), minlength=block.num_rows) if len(row) else np.zeros(block.num_rows)
        return pa.table({"id": block["id"], "n_words": pa.array(per, pa.int64()), "log_score": pa.array(summed)})

    return run


def _corpus_counts(grams: np.ndarray, row: np.ndarray, keys: np.ndarray, counts: np.ndarray, leave_out: bool) -> np.ndarray:
    """Each position's n-gram's count, less those of its own document."""
    out = np.zeros(len(grams), np.int64)
    real = grams != 0
    at = np.searchsorted(keys, grams[real])
    out[real] = counts[at]
    if leave_out and real.any():
        r = row[real]
        order = np.lexsort((at, r))
        new = np.concatenate(([True], (r[order][1:] != r[order][:-1]) | (at[order][1:] != at[order][:-1])))
        group = np.cumsum(new) - 1
        own = np.empty(len(at), np.int64)
        own[order] = np.bincount(group)[group]
        out[real] -= own
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, leave_out: bool = True, blocks: int | None = None) -> DataFrame:
    """Per document: words, sum of the words' log scores, and their mean.

    ``blocks`` is how many blocks and parts there are; the default is one for
    BLOCK_BYTES of text, and one for each core at least.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total, size = (x or 0 for x in source.select("text").mapInArrow(_count_words, "n long, size long").agg(F.sum("n"), F.sum("size")).first())
    n = blocks or max(-(-size // BLOCK_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = source.mapInArrow(_pieces(n, max(1, min(PIECE_BYTES, size // (8 * n)))), "block int, data binary")
    kind = source.schema["id"].dataType.simpleString()
    sent = dealt.groupBy("block").applyInArrow(_send(order, n), "part int, block int, keys binary, counts binary")
    answers = sent.groupBy("part").applyInArrow(_answer, "block int, part int, counts binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, n, leave_out, total), f"id {kind}, n_words long, log_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", F.round("log_score", 6).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("mean_log_score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
