"""Ranked lexical search over an index of clusters that recursive graph bisection puts together.

Indexing: each task splits its documents into shards of bounded bytes.  In a
shard, documents and terms are a graph, and recursive bisection orders the
documents so that those of like terms stand together: a run of documents is cut
in half, and pairs of documents trade sides while that lowers the estimated
logarithmic gaps of the terms' postings, then each half goes on by itself.  The
runs that are left are the clusters, an index row each: document ids, lengths,
postings by term hash, and for each term its largest part of a score in the
cluster.  No document is shuffled.

Search: queries come in blocks of bounded bytes.  A cluster's bound for a query
is the sum of its terms' weights times their largest parts.  First every batch
of clusters answers each query from its best cluster alone; the kth best score
of these answers, over all batches, is the query's floor.  Then every task
visits its clusters by falling bound and stops where the bound is below the
floor or below its own kth score, so no document that could be among the k best
is left out.  Documents are told apart by their ids only at the end, so that
equal scores go by id whatever order the index has.

Defined results for odd input: null and empty texts hold no term and are found
by nothing, as items they find nothing; texts of any length are read whole; rows
without id take no part and count for nothing; rows that repeat an id are ranked
each; rows of the items that repeat an item_id are answered each; equal scores
go to the smaller id; empty tables give an empty result; only the id and text
columns are read.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.graph import bounded_batches, checkpoint
from quarrylight.llm.terms import Terms
from quarrylight.llm.textops import chunks

#: Bytes of text of a shard, documents of a cluster at most, and rounds of trades at a cut.
SHARD_BYTES, CLUSTER, ROUNDS = 8 << 20, 128, 8
SHARD_DOCS = 1 << 16
#: Bytes of the texts of a block of queries, unless one alone has more.
QUERY_BYTES = 1 << 20

INDEX = "ids binary, lengths binary, terms binary, begins binary, docs binary, tfs binary, most binary"
FOUND = "query int, doc_id long, score long"


@dataclass
class Postings:
    """Of some documents: each entry's document, term (a place in ``hashes``) and count, by document; and terms of a document with repeats."""

    docs: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Postings:
        rows, found, lengths = [], [], []
        for lo, hi in chunks(texts):
            terms = Terms(texts.slice(lo, hi - lo))
            rows.append(terms.row + lo)
            found.append(terms.hashes())
            lengths.append(terms.counts)
        hashes, term = np.unique(np.concatenate(found), return_inverse=True)
        key, counts = np.unique(np.concatenate(rows) * max(len(hashes), 1) + term, return_counts=True)
        return cls(key // max(len(hashes), 1), key % max(len(hashes), 1), counts, hashes, np.concatenate(lengths))


def bisected(docs: np.ndarray, terms: np.ndarray, n: int, most: int = CLUSTER) -> list[np.ndarray]:
    """Documents 0 to n - 1 in runs of at most ``most``, by recursive bisection of the graph of entries (docs, terms), sorted by docs."""
    done, left = [], [(np.arange(n), docs, terms)]
    while left:
        own, d, t = left.pop()
        if len(own) <= most:
            done.append(own)
            continue
        shared = np.bincount(t) >= 2 if len(t) else np.zeros(0, bool)  # a term of one document costs the same anywhere
        keep = shared[t]
        d, t = d[keep], (np.cumsum(shared) - 1)[t[keep]]
        right = _trade(d, t, len(own))
        for side in (right, ~right):  # the last that is put away goes on first, so runs come from left to right
            place = np.cumsum(side) - 1
            of = side[d]
            left.append((own[side], place[d[of]], t[of]))
    return done


def _trade(d: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """Which documents go right: half of them, after pairs have traded sides for as long as it pays."""
    right = np.arange(n) >= n // 2
    n_terms = int(t.max(initial=-1)) + 1
    degree = np.bincount(t, minlength=n_terms)
    logs = np.log2(np.arange(n + 2) + 1.0)
    a_log, b_log = math.log2(n // 2), math.log2(n - n // 2)
    cost = lambda x, size: x * (size - logs[x])  # noqa: E731  entries times the logarithm of their mean gap
    for _ in range(ROUNDS):
        of = right[d]
        b = np.bincount(t[of], minlength=n_terms)
        a = degree - b
        now = cost(a, a_log) + cost(b, b_log)
        to_right = now - cost(np.maximum(a - 1, 0), a_log) - cost(b + 1, b_log)
        to_left = now - cost(a + 1, a_log) - cost(np.maximum(b - 1, 0), b_log)
        gain = np.bincount(d, np.where(of, to_left[t], to_right[t]), minlength=n)
        lefts, rights = np.flatnonzero(~right), np.flatnonzero(right)
        lefts, rights = lefts[np.argsort(-gain[lefts], kind="stable")], rights[np.argsort(-gain[rights], kind="stable")]
        m = min(len(lefts), len(rights))
        trades = int(np.count_nonzero(gain[lefts[:m]] + gain[rights[:m]] > 1e-9))
        if not trades:
            break
        right[lefts[:trades]], right[rights[:trades]] = True, False
    return right


def part_of_score(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that occurs so often adds to a document's score, per unit of its weight."""
    if n_terms * 1.0 * n_docs >= 2**56:  # whole numbers of any size
        m = np.array([10 + 90 * int(x) * n_docs // max(n_terms, 1) for x in lengths], np.int64)
    else:
        m = 10 + 90 * lengths * n_docs // max(n_terms, 1)
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def clusters(ids: np.ndarray, texts: pa.Array, n_docs: int, n_terms: int, most: int = CLUSTER) -> Iterator[tuple[bytes, ...]]:
    """The index rows of one shard."""
    every = Postings.of(texts)
    run_of, place = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    runs = bisected(every.docs, every.terms, len(ids), most)
    for i, own in enumerate(runs):
        run_of[own], place[own] = i, np.arange(len(own))
    order = np.lexsort((place[every.docs], every.terms, run_of[every.docs]))
    docs, terms, counts = every.docs[order], every.terms[order], every.counts[order].astype(np.int64)
    edges = np.searchsorted(run_of[docs], np.arange(len(runs) + 1))
    for own, lo, hi in zip(runs, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        term, tf, doc = terms[lo:hi], counts[lo:hi], docs[lo:hi]
        begins = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if hi > lo else np.zeros(0, np.int64)
        part = part_of_score(tf, every.lengths[doc], n_docs, n_terms)
        best = np.maximum.reduceat(part, begins) if hi > lo else part
        yield (
            ids[own].astype(np.int64).tobytes(),
            every.lengths[own].astype(np.int64).tobytes(),
            every.hashes[term[begins]].tobytes(),
            begins.astype(np.uint32).tobytes(),
            place[doc].astype(np.uint16).tobytes(),
            tf.astype(np.uint32).tobytes(),
            best.astype(np.uint32).tobytes(),
        )


def _indexing(n_docs: int, n_terms: int, most: int):
    names = [f.split()[0] for f in INDEX.split(", ")]

    def rows(ids: list[pa.Array], texts: list[pa.Array]) -> pa.RecordBatch:
        made = list(clusters(pa.concat_arrays(ids).to_numpy(), pa.concat_arrays(texts), n_docs, n_terms, most))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*made, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, n = [], [], 0, 0
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                part = batch.column(1).slice(lo, hi - lo)
                if n and (size + part.nbytes > SHARD_BYTES or n + hi - lo > SHARD_DOCS):
                    yield rows(ids, texts)
                    ids, texts, size, n = [], [], 0, 0
                ids.append(batch.column(0).slice(lo, hi - lo))
                texts.append(part)
                size, n = size + part.nbytes, n + hi - lo
        if n:
            yield rows(ids, texts)

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        counts = np.concatenate([np.zeros(0, np.int64), *(Terms(texts.slice(lo, hi - lo)).counts for lo, hi in chunks(texts))])
        yield pa.RecordBatch.from_arrays([pa.array([int(np.count_nonzero(counts))]), pa.array([int(counts.sum())])], ["n", "l"])


@dataclass
class ClusterIndex:
    """Index rows, how many documents have a term, and all their terms with repeats."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def cluster_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = CLUSTER) -> ClusterIndex:
    """Indexes every document where it is read."""
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    row = read.select("text").mapInArrow(_measure, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    n_docs, n_terms = row[0] or 0, row[1] or 0
    return ClusterIndex(checkpoint(read.mapInArrow(_indexing(n_docs, n_terms, most), INDEX)), n_docs, n_terms)


@dataclass
class Block:
    """A block of queries: hashes of all their terms, sorted; each query's terms as places among these; their weights."""

    hashes: np.ndarray
    queries: list[np.ndarray]
    weights: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        terms = Terms(pa.array(texts, pa.large_string()))
        hashes, place = np.unique(terms.hashes(), return_inverse=True)
        ends = np.cumsum(terms.counts)
        return cls(hashes, [np.unique(place[e - n : e]) for e, n in zip(ends.tolist(), terms.counts.tolist(), strict=True)], np.zeros(len(hashes), np.int64))


class Cluster:
    """One index row, as far as the terms of a block of queries go."""

    def __init__(self, row: dict, block: Block):
        self.row = row
        terms = np.frombuffer(row["terms"], np.uint64)
        at = np.searchsorted(terms, block.hashes)
        at[at == len(terms)] = 0
        self.has = terms[at] == block.hashes if len(terms) else np.zeros(len(block.hashes), bool)
        self.at = at
        self.begins = np.append(np.frombuffer(row["begins"], np.uint32), len(row["tfs"]) // 4).astype(np.int64)

    def sizes(self) -> np.ndarray:
        """In how many of its documents each term of the block occurs."""
        return np.where(self.has, self.begins[self.at + self.has] - self.begins[self.at], 0)

    def most(self) -> np.ndarray:
        """The largest part of a score that each term of the block has here."""
        found = np.zeros(len(self.has), np.int64)
        found[self.has] = np.frombuffer(self.row["most"], np.uint32)[self.at[self.has]]
        return found

    def open(self, n_docs: int, n_terms: int) -> None:
        self.ids = np.frombuffer(self.row["ids"], np.int64)
        lengths = np.frombuffer(self.row["lengths"], np.int64)
        self.docs = np.frombuffer(self.row["docs"], np.uint16)
        self.part = part_of_score(np.frombuffer(self.row["tfs"], np.uint32).astype(np.int64), lengths[self.docs], n_docs, n_terms)

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The score of each document for these terms."""
        out = np.zeros(len(self.ids), np.int64)
        for t in terms[self.has[terms]].tolist():
            lo, hi = self.begins[self.at[t]], self.begins[self.at[t] + 1]
            out[self.docs[lo:hi]] += weights[t] * self.part[lo:hi]
        return out


class Visitor:
    """Answers a block of queries from batches of clusters; ``visited`` counts pairs of query and cluster that were scored."""

    def __init__(self, block: Block, n_docs: int, n_terms: int, k: int, floors: np.ndarray | None, best_only: bool = False):
        self.block, self.n_docs, self.n_terms, self.k, self.best_only = block, n_docs, n_terms, k, best_only
        self.floors = np.ones(len(block.queries), np.int64) if floors is None else np.maximum(floors, 1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in block.queries]
        self.visited = self.met = 0

    def least(self, query: int) -> int:
        """The score that a document needs here: that of the floor, or of the kth so far."""
        own = self.best[query]
        return max(int(self.floors[query]), -own[-1][0] if len(own) == self.k else 0)

    def batch(self, rows: list[dict]) -> None:
        found = [Cluster(row, self.block) for row in rows]
        if not found:
            return
        most = np.stack([c.most() for c in found], 1) * self.block.weights[:, None]
        for query, terms in enumerate(self.block.queries):
            bounds = most[terms].sum(axis=0)
            order = np.argsort(-bounds, kind="stable").tolist()
            self.met += len(order)
            for i in order[:1] if self.best_only else order:
                if bounds[i] < self.least(query):
                    break
                self.visit(query, found[i])

    def visit(self, query: int, cluster: Cluster) -> None:
        self.visited += 1
        if not hasattr(cluster, "ids"):
            cluster.open(self.n_docs, self.n_terms)
        scores = cluster.scores(self.block.queries[query], self.block.weights)
        good = np.flatnonzero(scores >= self.least(query))
        if len(good):
            more = zip((-scores[good]).tolist(), cluster.ids[good].tolist(), strict=True)
            self.best[query] = sorted([*self.best[query], *more])[: self.k]

    def answers(self) -> pa.RecordBatch:
        rows = [(q, id_, -score) for q, own in enumerate(self.best) for score, id_ in own]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])


def _frequencies(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.hashes), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += Cluster(row, block).sizes()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    return run


def _search(index: ClusterIndex, block: Block, k: int, floors: np.ndarray | None, best_only: bool) -> DataFrame:
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Visitor(block, n_docs, n_terms, k, floors, best_only)
        for batch in batches:
            visitor.batch(batch.to_pylist())
        yield visitor.answers()

    return index.rows.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search_block(index: ClusterIndex, texts: list[str | None], k: int = 10) -> DataFrame:
    """(query, rank, doc_id, score) for a block of query texts, by their places in the list."""
    block = Block.of(texts)
    df = index.rows.select("terms", "begins", "tfs").mapInArrow(_frequencies(block), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    frequency = np.zeros(len(block.hashes), np.int64)
    for row in df.collect():  # a row for each term of the block
        frequency[row["term"]] = row["df"]
    block.weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in frequency.tolist()], np.int64)
    first = _ranked(_search(index, block, k, None, True), k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    floors = np.zeros(len(texts), np.int64)
    for row in first.filter(F.col("n") == k).collect():  # a row for each query of the block
        floors[row["query"]] = row["floor"]
    return _ranked(_search(index, block, k, floors, False), k).select("query", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = CLUSTER) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents for each item."""
    spark = docs.sparkSession
    index = cluster_index(docs, id_col, text_col, most)
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))):
        own = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item_id {kind}")
        found = search_block(index, [text for _, text in block], k)
        out = out.unionByName(found.join(F.broadcast(own), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        own = 64 + len(row["text"] or "")
        if block and size + own > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += own
    if block:
        yield block


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return ranked_search(documents, benchmark)


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), totals AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE len(w) > 0
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY ALL
), asked AS (
  SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), weighed AS (
  SELECT q, item_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (term), totals
), scored AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM weighed JOIN tf USING (term), totals GROUP BY q, item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
