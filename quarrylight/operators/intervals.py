"""Ranges that contain other ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(start: Column, end: Column, position: Column) -> Column:
    """Both ends belong to the range."""
    return (start <= position) & (end >= position)


def smallest_enclosing(inner: DataFrame, outer: DataFrame, keys: list[str], inner_id: str, outer_id: str, start: str = "start", end: str = "end", grid: int = 4096) -> DataFrame:
    """(keys, inner_id, outer_id): for each inner range the shortest outer one that holds it, ties to the smaller id.

    An equi-join on the keys and a grid cell: an outer range is listed in every
    cell that it touches, an inner one only in the cell of its start, so a key
    with very many ranges is dealt out and only nearby ranges are compared.
    Equal ranges are compared once, whoever has them, and the shortest length
    is found before the range that has it, so that no sort of the pairs is needed.
    """
    cell = lambda c: F.floor(F.col(c) / grid)
    found = [*keys, "_is", "_ie"]
    distinct = outer.groupBy(*keys, F.col(start).alias("_os"), F.col(end).alias("_oe")).agg(F.min(outer_id).alias("_outer"))
    o = distinct.withColumn("_length", F.col("_oe") - F.col("_os")).withColumn("_cell", F.explode(F.sequence(cell("_os"), cell("_oe"))))
    ranges = inner.select(*keys, F.col(inner_id).alias("_inner"), F.col(start).alias("_is"), F.col(end).alias("_ie"))
    i = ranges.select(*found).distinct().withColumn("_cell", cell("_is"))
    holds = (F.col("_os") <= F.col("_is")) & (F.col("_oe") >= F.col("_ie"))
    shortest = i.join(o, [*keys, "_cell"]).filter(holds).groupBy(*found, "_cell").agg(F.min("_length").alias("_length"))
    best = shortest.join(o, [*keys, "_cell", "_length"]).filter(holds).groupBy(*found, "_length").agg(F.min("_outer").alias("_outer"))
    held = ranges.join(best, found).groupBy(*keys, "_inner").agg(F.min(F.struct("_length", "_outer"))["_outer"].alias("_best"))
    return held.select(*keys, F.col("_inner").alias(inner_id), F.col("_best").alias(outer_id))


def find_at(ranges: DataFrame, position: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges that hold a position, shortest first."""
    return ranges.filter(contains(F.col(start), F.col(end), position)).orderBy(F.col(end) - F.col(start), start)


def inside(ranges: DataFrame, lo: int, hi: int, start: str = "start", end: str = "end") -> DataFrame:
    return ranges.filter((F.col(start) >= lo) & (F.col(end) <= hi))
