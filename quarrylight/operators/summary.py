"""Counts and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per value, most first, ties by value."""
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key)


def conditional_counts(df: DataFrame, conditions: dict[str, Column], total: str = "total", rest: str | None = "other") -> DataFrame:
    """One row: all rows, rows per condition, and rows that meet none."""
    none = F.lit(True)
    for c in conditions.values():
        none = none & ~F.coalesce(c, F.lit(False))
    counts = [F.count("*").alias(total), *(F.count_if(c).alias(k) for k, c in conditions.items())]
    return df.agg(*counts, *([F.count_if(none).alias(rest)] if rest else []))


def latest(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The row with the largest ``by`` of each key, whole; in the aggregation, without a sort of the groups."""
    others = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*by)).alias("_row"))
    return best.select(*key, "_row.*")


def resolution_counts(df: DataFrame, state: str, states: list[str]) -> DataFrame:
    """One row with a count per state."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col(state) == s).alias(s) for s in states))


def composite(base: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Independent aggregates per key beside each other; missing counts are 0."""
    out = base
    for part in parts.values():
        out = out.join(part, key, "left")
    return out.fillna(0)
