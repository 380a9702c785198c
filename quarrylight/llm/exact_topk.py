"""Exact top-k inner products by the threshold algorithm.

Candidates are dealt to blocks of bounded size, and so are queries.  A candidate
block sorts its rows once per dimension and then answers a block of queries.
For a query the lists are read from the end that its sign prefers, a batch of
ranks at a time; every row seen is scored in full, and reading stops when the
kth best score beats the bound, the inner product of the query with the values
last read.  Every query first meets one candidate block; its kth best score
there is a floor that the other blocks' bounds are held against as well.  The
blocks' winners are then ranked.

Defined results for odd input: vectors that are null, or hold a null or a
non-finite component, and rows without id take no part; shorter vectors count
as padded with zeros, and vectors of any length are read whole; every query row
is answered by itself and leaves out itself alone, so rows that repeat its id
are candidates and an id on two query rows has two answers; ties go to the
smaller id; scores out of the range of a long take its nearest end; empty
tables give an empty result; only the id and vector columns, and what the
choice of queries names, are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.graph import checkpoint, sized

CANDIDATES, QUERIES = 32768, 8192
#: Fewer candidates than this aren't split further to keep more tasks busy.
FEW = 2048
#: Ranks of each list that are read before the bound is first held against the kth score; each batch after reads twice as many.
FIRST_RANKS = 2


def _long(score) -> int:
    return min(max(int(score), -(1 << 63)), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine), F.lit(False))


def scaled(vectors: pa.ChunkedArray, scale: int, dims: int) -> np.ndarray:
    """Rows of floor(scale * x); exact integers as floats, or as objects where floats would round."""
    arrays = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    out = np.zeros((len(arrays), dims))
    sizes = arrays.value_lengths().to_numpy()
    flat = np.floor(arrays.flatten().to_numpy().astype(np.float64) * scale)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Lists:
    """A block's vectors with its rows sorted by each dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.largest = float(np.abs(vectors).max(initial=0))
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.scored = 0

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without the row ``own``; those below ``floor`` may lack."""
        n = len(self.ids)
        dims = np.flatnonzero(query != 0)
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(len(query), 1) < 2**53
        seen = np.zeros(n, bool)
        best: list[tuple[int, int]] = []
        down = query[dims] > 0
        lo, ranks = 0, FIRST_RANKS
        if not len(dims):
            lo, ranks = 0, n
        while lo < n:
            hi = min(n, lo + ranks)
            if len(dims) and hi < n:
                read = np.where(down, self.order[::-1][lo:hi][:, dims], self.order[lo:hi][:, dims])
                new = np.unique(read)
                new = new[~seen[new]]
            else:
                new = np.flatnonzero(~seen)
            seen[new] = True
            self.scored += len(new)
            scores = self.scores(new, query, exact)
            keep = self.rows[new] != own
            scores, ids = scores[keep], self.ids[new][keep]
            if len(scores) > k and exact:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                scores, ids = scores[scores >= least], ids[scores >= least]
            best = sorted([*best, *zip(map(_long, scores), map(int, ids), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
            if hi < n and len(dims) and (len(best) == k or floor is not None):
                last = self.vectors[np.where(down, self.order[n - hi, dims], self.order[hi - 1, dims]), dims]
                bound = last @ query[dims] if exact else sum(int(a) * int(b) for a, b in zip(last, query[dims], strict=True))
                beaten = max(best[-1][0] if len(best) == k else -(1 << 63), -(1 << 63) if floor is None else floor)
                if beaten > _long(bound):
                    break
            lo, ranks = hi, ranks * 2
            if hi == n:
                break
        return best

    def scores(self, rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return self.vectors[rows] @ query
        q = [int(x) for x in query]
        return np.array([sum(int(a) * b for a, b in zip(v, q, strict=True)) for v in self.vectors[rows]], object)


FOUND = "query long, query_id long, vec_id long, score long"


def _search(k: int, scale: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and rows.num_rows:
            size = lambda v: max(v.combine_chunks().value_lengths().to_pylist(), default=0)
            dims = max(size(queries["vector"]), size(rows["c_vector"]))
            lists = Lists(rows["c_row"].to_numpy(), rows["c_id"].to_numpy(), scaled(rows["c_vector"], scale, dims))
            for own, id_, floor, query in zip(queries["row"].to_pylist(), queries["id"].to_pylist(), queries["floor"].to_pylist(), scaled(queries["vector"], scale, dims), strict=True):
                for score, vec in lists.top(query, own, k, floor):
                    for name, value in zip(out, (own, id_, vec, score), strict=True):
                        out[name].append(value)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k best rows for each query row: query_id, rank, vec_id, score."""
    usable_rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    # a row is told from others by its number, which is written down with it
    usable_rows = checkpoint(usable_rows.withColumn("row", F.monotonically_increasing_id()))
    n, nq = usable_rows.agg(F.count("*"), F.count_if("q")).first()
    cb, qb = max(1, -(-n // CANDIDATES), min(sized(vectors.sparkSession), -(-n // FEW))), max(1, -(-nq // QUERIES))
    dealt = lambda seed, m: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")
    rows = usable_rows.select("row", "id", "vector", dealt(0, cb)).toDF("c_row", "c_id", "c_vector", "c_cb")
    queries = usable_rows.filter("q").select("row", "id", "vector", dealt(1, qb).alias("qb"), dealt(2, cb).alias("home"))
    search = _search(k, scale)

    def against(asked: DataFrame, among: DataFrame) -> DataFrame:
        each = among.withColumn("c_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
        return asked.groupBy("qb", "cb").cogroup(each.groupBy("c_qb", "c_cb")).applyInArrow(search, FOUND)

    found = checkpoint(against(queries.select("row", "id", "vector", "qb", F.col("home").alias("cb"), F.lit(None).cast("long").alias("floor")), rows))
    if cb > 1:
        floors = found.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).withColumnRenamed("query", "of")
        rest = queries.join(floors, F.col("row") == F.col("of"), "left").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))).filter("cb <> home")
        found = found.unionByName(against(rest.select("row", "id", "vector", "qb", "cb", "floor"), rows))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
