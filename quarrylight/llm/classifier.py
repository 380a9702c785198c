"""Quality and toxicity by hierarchical empirical Bayes.

A document's own evidence is a logistic classifier over hashed words, word
beginnings and binned style measures, with one head for quality and one for
toxicity.  It is fitted on at most about SAMPLE labelled documents of SAMPLE_BYTES,
chosen by hash, one row an id; that bound is the only sample taken.  Every document is
then scored, the evidence is summed per host and per path of a host, the host
posterior shrinks towards all documents and the path posterior towards its
host, and the path posterior shifts the document's log-odds.  How much either
shrinks is estimated from the data: the concentration of a beta prior whose
variance is that of the hosts' rates around the mean of all, and that of the
paths' rates around their hosts', weighted by documents.

Defined results for odd input: a null or empty text has the prior's evidence
and is rejected (it holds no words); null hosts and paths are ''; labels that
are null, or of ids that the table lacks, are left out, and an id with several
labels counts as bad if one is; without both good and bad labels a head gives
even odds and rejects nothing; repeated rows and ids are judged each; odds that
tie with even ones reject nothing; texts of any length are scored whole; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm import textops
from quarrylight.llm.graph import bounded_batches, checkpoint
from quarrylight.llm.skew import hot_join

BITS = 18
SAMPLE = 8_000
#: Bytes of packed features that the fit takes at most; labelled documents beyond, in order of their hash, are left out of it.
SAMPLE_BYTES = 96 << 20
#: Within which the pseudo-documents lie by which a host shrinks towards all and a path towards its host.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e4
#: How far a site's log-odds shift a document's own.
SITE_WEIGHT = 0.5
#: Odds this near to even reject nothing, whatever rounding does.
EVEN = 1e-3
STARTS = (5, 6, 7, 8)

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each feature, feature, words per row): distinct hashed features of each text."""
    words = textops.Words(texts)
    n_rows = len(texts)
    raw = textops.byte_view(texts)[0]
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(4):  # punctuation around a word is no part of it
        ends -= _PUNCTUATION[words.bytes[ends - 1]] & (ends - starts > 1)
    for _ in range(2):
        starts += _PUNCTUATION[words.bytes[starts]] & (ends - starts > 1)
    view = textops.eights(words.bytes)
    mask = np.uint64((1 << BITS) - 1)
    rows, found = [], []
    whole = textops.span_hashes(words.bytes, starts, ends)
    rows.append(words.row)
    found.append(whole & mask)
    for k in STARTS:
        long = ends - starts > k
        s = starts[long]
        rows.append(words.row[long])
        found.append(textops.mix(view[s] & np.uint64((1 << 8 * k) - 1) ^ np.uint64(k << 58)) & mask)
    style_rows, style = _style(raw, words, whole, n_rows)
    rows.append(style_rows)
    found.append(style)
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(found)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key >> np.uint64(BITS)).astype(np.int64), (key & mask).astype(np.int64), words.counts


def _style(raw: np.ndarray, words: textops.Words, whole: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One feature per measure and row: the measure's number and bin, hashed."""
    n = np.maximum(words.counts, 1)
    at = words.offsets
    per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[at])
    symbol = np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8))
    pair = np.unique((words.row.astype(np.uint64) << np.uint64(44)) ^ (whole >> np.uint64(20)))
    distinct = np.bincount((pair >> np.uint64(44)).astype(np.int64), minlength=n_rows)[:n_rows]
    same = np.zeros(len(whole), bool)
    if len(whole) > 1:
        same[1:] = (whole[1:] == whole[:-1]) & (words.row[1:] == words.row[:-1])
    repeated = np.bincount(words.row[same], minlength=n_rows)[:n_rows]
    bytes_ = np.maximum(np.diff(at), 1)
    bins = [
        np.minimum(np.log2(n), 14).astype(np.int64),
        np.minimum(10 * per(symbol) / n, 20).astype(np.int64),
        np.minimum(10 * per(raw == ord("!")) / n, 20).astype(np.int64),
        np.minimum(10 * per(raw == ord("|")) / n, 10).astype(np.int64),
        (10 * per(_UPPER[raw]) / bytes_).astype(np.int64),
        (10 * distinct / n).astype(np.int64),
        np.minimum(20 * repeated / n, 20).astype(np.int64),
        np.minimum(per(raw == 10) * 10 / n, 10).astype(np.int64),
        np.minimum(bytes_ / n, 20).astype(np.int64),
    ]
    rows = np.tile(np.arange(n_rows), len(bins))
    code = np.concatenate([(np.uint64(1) << np.uint64(40)) + np.uint64(64 * i) + b.astype(np.uint64) for i, b in enumerate(bins)])
    return rows, textops.mix(code) & np.uint64((1 << BITS) - 1)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, good, toxic, text) to (key, good, toxic, packed features)."""
    for batch in batches:
        for lo, hi in textops.chunks(batch.column(3)):
            row, feature, _ = features(batch.column(3).slice(lo, hi - lo))
            cuts = np.searchsorted(row, np.arange(hi - lo + 1))
            feature = feature.astype(np.uint32)
            packed = [feature[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(packed, pa.binary())], ["key", "good", "toxic", "features"])


def fit(flat: np.ndarray, sizes: np.ndarray, targets: np.ndarray, rounds: int = 300, pace: float = 0.1, decay: float = 3e-5, least_z: float = 5.0) -> np.ndarray:
    """Logistic weights, the last one the intercept; zero where there is but one kind of target.

    ``flat`` holds the examples' features one after the other, ``sizes`` of them each.
    """
    weights = np.zeros((1 << BITS) + 1, np.float32)
    if not len(targets) or targets.min() == targets.max():
        return weights
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # features whose share differs little between the two kinds would only be learnt by heart
    good, bad = targets.sum(), len(targets) - targets.sum()
    seen, within = (np.bincount(x, minlength=1 << BITS) for x in (flat, flat[(targets == 1)[row]]))
    rate = seen / len(targets)
    apart = (within / good - (seen - within) / bad) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / good + 1 / bad))
    telling = (np.abs(apart) >= min(least_z, 0.6 * np.sqrt(len(targets)))) & (seen >= 3)  # z can't pass the root of n
    used, keep = np.flatnonzero(telling), telling[flat]
    index, row = (np.cumsum(telling) - 1)[flat[keep]], row[keep]
    share = np.where(targets == 1, 0.5 / max(targets.mean(), 1e-9), 0.5 / max(1 - targets.mean(), 1e-9))
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[index], minlength=len(sizes)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) * share / len(targets)
        gw, gb = np.bincount(index, g[row], minlength=len(used)) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = pace * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-12)
    weights[used] = w
    weights[-1] = b
    return weights


def _heads(rows: pa.Table) -> list[np.ndarray]:
    """The weights of both heads, from the sample in an order of its own."""
    packed = rows["features"].combine_chunks()
    packed = packed.cast(pa.large_binary()) if not pa.types.is_large_binary(packed.type) else packed
    _, offsets, data = packed.buffers()
    at = np.frombuffer(offsets, np.int64, len(packed) + 1, packed.offset * 8) if len(packed) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint32, int(at[-1] - at[0]) // 4, int(at[0])) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint32)
    return [fit(flat, np.diff(at) // 4, (rows[c].to_numpy() > 0).astype(np.float64)) for c in ("good", "toxic")]


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample, all of it, to one row: the weights of both heads, packed."""
    if some := list(batches):
        heads = _heads(pa.Table.from_batches(some).sort_by("key"))
        yield pa.RecordBatch.from_arrays([pa.array([h.astype(np.float32).tobytes()], pa.binary()) for h in heads], ["good", "toxic"])


def _score(heads: list[np.ndarray]):
    """(id, host, path, text), the id being one column or a whole row, to (id, host, path, n_words, log-odds of each head in millionths)."""
    tables = [h.astype(np.float32) for h in heads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textops.chunks(batch.column(3)):
                row, feature, words = features(batch.column(3).slice(lo, hi - lo))
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(3)] + [pa.array(words)]
                for table in tables:
                    z = np.bincount(row, table[feature].astype(np.float64), minlength=hi - lo) + float(table[-1])
                    columns.append(pa.array(np.round(np.clip(z, -30, 30) * 1e6).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_host", "_path", "_words", "_good", "_toxic"])

    return run


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(inside / (1 - inside))


def concentration(spread: float, variance: float) -> float:
    """The size of the beta prior with a mean of p (1 - p) = ``spread`` and this variance, by moments."""
    return round(min(max(spread / max(variance, 1e-9) - 1, LEAST_PRIOR), MOST_PRIOR), 6)


def site_shifts(scored: DataFrame) -> tuple[DataFrame, int]:
    """(_host, _path, n) with the shift of either head's log-odds, and the sum of n.

    Evidence is summed as integers, so the sums don't depend on their order.
    """
    chance = lambda c: F.round(1e6 / (1 + F.exp(-F.col(c) / 1e6))).cast("long")
    paths = scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(chance("_good")).alias("good"), F.sum(chance("_toxic")).alias("toxic"))
    paths = checkpoint(paths)
    hosts = checkpoint(paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"), F.sum("toxic").alias("htoxic")))
    # sums over sites of (sum of chances)**2 / documents, as whole millionths of a document
    square = lambda c, n: F.sum(F.round(F.col(c) / 1e6 * F.col(c) / F.col(n)).cast("long"))
    within = paths.agg(square("good", "n").alias("good"), square("toxic", "n").alias("toxic")).first()
    among = hosts.agg(square("hgood", "hn").alias("good"), square("htoxic", "hn").alias("toxic")).first()
    every = hosts.agg(F.sum("hn").alias("n"), F.sum("hgood").alias("good"), F.sum("htoxic").alias("toxic")).first()
    n = max(every["n"] or 0, 1)
    joined = paths.join(hosts, "_host")
    out = []
    for head in ("good", "toxic"):
        mean, of_hosts, of_paths = (x / 1e6 / n for x in (every[head] or 0, among[head] or 0, within[head] or 0))
        host_prior = concentration(mean * (1 - mean), of_hosts - mean * mean)
        path_prior = concentration(mean - of_hosts, of_paths - of_hosts)
        prior = F.lit(mean)
        host = (F.col(f"h{head}") / 1e6 + host_prior * prior) / (F.col("hn") + host_prior)
        path = (F.col(head) / 1e6 + path_prior * host) / (F.col("n") + path_prior)
        out.append((SITE_WEIGHT * (_logit(path) - _logit(prior))).alias(f"_{head}_shift"))
    return joined.select("_host", "_path", "n", *out), every["n"] or 0


def _sources(docs: DataFrame, what: Column, text_col: str, host_col: str, path_col: str) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(what.alias("_id"), part(host_col).alias("_host"), part(path_col).alias("_path"), F.col(text_col).cast("string").alias("_text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[np.ndarray]:
    """The weights of both heads.  labels holds (id, quality 0/1, toxic 0/1)."""
    usable = labels.select(F.col(id_col).alias("_id"), "quality", "toxic").dropna().groupBy("_id").agg(F.min("quality").alias("good"), F.max("toxic").alias("toxic"))
    n, wide = usable.count(), 1 << 50
    few = usable if n <= sample else usable.filter(F.pmod(F.xxhash64("_id"), F.lit(wide)) < int(sample / n * wide))
    # of rows that share an id the least text counts, so an id is one example however many rows it has
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).dropna().join(few, "_id")
    texts = texts.groupBy("_id", "good", "toxic").agg(F.min("_text").alias("_text")).select(F.xxhash64("_id", "_text").alias("key"), "good", "toxic", "_text")
    held = texts.mapInArrow(_sample_features, "key long, good int, toxic int, features binary")
    # the sample is at most about ``sample`` rows, so one task may add up its bytes and fit on it: the driver gets the weights only
    bounded = held.withColumn("_sum", F.sum(F.octet_length("features")).over(Window.orderBy("key", "good", "toxic"))).filter(F.col("_sum") <= sample_bytes).drop("_sum")
    fitted = bounded.coalesce(1).mapInArrow(_fitted, "good binary, toxic binary").collect()
    return [np.frombuffer(w, np.float32) for w in fitted[0]] if fitted else [np.zeros((1 << BITS) + 1, np.float32)] * 2


def _scored(source: DataFrame, heads: list[np.ndarray]) -> DataFrame:
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(_score(heads), f"_id {kind}, _host string, _path string, _words long, _good long, _toxic long")


def _judged(scored: DataFrame, sites: tuple[DataFrame, int]) -> DataFrame:
    """Adds the posterior chances of both heads and ``kept``."""
    shifts, total = sites
    judged = hot_join(scored, shifts, ["_host", "_path"], "n", total, F.monotonically_increasing_id())
    odds = lambda h: F.col(f"_{h}") / 1e6 + F.col(f"_{h}_shift")
    chance = lambda h: F.round(1 / (1 + F.exp(-odds(h))), 6)
    return judged.withColumns({"quality": chance("good"), "toxicity": chance("toxic"), "kept": (F.col("_words") > 0) & (odds("good") >= -EVEN) & (odds("toxic") <= EVEN)})


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    sample: int = SAMPLE,
) -> DataFrame:
    """Per document: posterior chances of quality and of toxicity, and ``kept``."""
    bounded_batches(docs.sparkSession)
    heads = train(docs, labels, id_col, text_col, sample)
    # a few numbers a document, read twice: for the sites' sums and for the verdicts
    scored = checkpoint(_scored(_sources(docs, F.col(id_col), text_col, host_col, path_col), heads))
    return _judged(scored, site_shifts(scored)).select(F.col("_id").alias(id_col), F.col("_words").alias("n_words"), "quality", "toxicity", "kept")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The documents, whole, that the classifier keeps, each row by its own verdict.

    Rows are scored twice, for the sites' sums and with the row at hand, so that
    no text is shuffled to meet its verdict.
    """
    bounded_batches(docs.sparkSession)
    heads = train(docs, labels, id_col, text_col, sample)
    shifts, total = site_shifts(_scored(_sources(docs, F.lit(0), text_col, host_col, path_col), heads))
    whole = _sources(docs, F.struct(*docs.columns), text_col, host_col, path_col)
    return _judged(_scored(whole, heads), (checkpoint(shifts), total)).filter("kept").select("_id.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))
