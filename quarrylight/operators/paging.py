"""Sorted pages with totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 50, 200
#: Rows of a run that are aimed at.
RUN_ROWS = 100_000


def clamp(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(max(DEFAULT_LIMIT if limit is None else limit, 1), MAX_LIMIT), max(offset or 0, 0)


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Rows offset to offset + limit in a total order, with ``total`` and ``has_more`` of the whole.

    The limit reaches the executors (each keeps its best offset + limit rows);
    the count is its own aggregation.
    """
    limit, offset = clamp(limit, offset)
    total = df.count()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(offset + limit < total)})


def merge_pages(parts: list[DataFrame], order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page over several ranked lists."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return page(whole, order, limit, offset)


@dataclass
class Listing:
    """A stored listing in runs: every row of a run comes before every row of the next."""

    spark: SparkSession
    at: str
    columns: str
    order: list[tuple[str, bool]]
    counts: list[int]

    def _keys(self) -> list[Column]:
        return [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in self.order]

    def _runs(self, runs: list[int]) -> DataFrame:
        """Some runs; the others' folders aren't read."""
        rows = self.spark.read.schema(f"{self.columns}, _run int").parquet(self.at)
        return rows.filter(F.col("_run").isin(runs)).drop("_run")

    def page(self, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """As :func:`page`; only the runs that the page lies in are read and sorted, however deep it is."""
        limit, offset = clamp(limit, offset)
        total, before, runs, skip = sum(self.counts), 0, [], 0
        for run, n in enumerate(self.counts):
            if before < offset + limit and offset < before + n:
                skip = skip if runs else offset - before
                runs.append(run)
            before += n
        rows = self._runs(runs).orderBy(*self._keys()).offset(skip).limit(limit)
        return rows.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(offset + limit < total)})

    def after(self, last: tuple, limit: int | None = None) -> DataFrame:
        """The rows that come right after one, given by its values of the order's columns: no offset is counted.

        Runs before the row's own are passed over by their files' statistics.
        """
        limit, _ = clamp(limit, 0)
        later, same = F.lit(False), F.lit(True)
        for (name, up), value in zip(self.order, last, strict=True):
            c, v = F.col(name), F.lit(value)
            if value is None:
                beyond = c.isNotNull() if up else F.lit(False)
            else:
                beyond = (c > v) if up else (c < v) | c.isNull()
            later = later | (same & beyond)
            same = same & c.eqNullSafe(v)
        return self._runs(list(range(len(self.counts)))).filter(later).orderBy(*self._keys()).limit(limit)


def listing(df: DataFrame, order: list[tuple[str, bool]], at: str, rows: int = RUN_ROWS) -> Listing:
    """Stores a listing below ``at`` in runs of about ``rows`` rows, by one range partitioning; ``order`` holds columns, true for ascending, and has no ties.

    Nulls come first where a column ascends, last where it descends.
    """
    keys = [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in order]
    n = max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_run", F.spark_partition_id())
    dealt.write.partitionBy("_run").parquet(at)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    counted = df.sparkSession.read.schema(f"{columns}, _run int").parquet(at).groupBy("_run").agg(F.count("*").alias("n"))
    sizes = {r["_run"]: r["n"] for r in counted.collect()}  # a row for each run
    return Listing(df.sparkSession, at, columns, order, [sizes.get(i, 0) for i in range(n)])
