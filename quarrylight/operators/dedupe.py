"""First-wins and last-wins rows of a key, and content copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the one that comes first, ties by the other columns; aggregated on both sides of the shuffle."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order, *(c for c in others if c not in order))).alias("_row")).select(*key, "_row.*").select(*df.columns)


def content_copies(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """Groups of equal content: hash, members, and the smallest id; the content itself isn't shuffled."""
    hashed = df.select(F.col(id_col).alias("id"), F.sha2(content, 256).alias("content_hash"))
    return hashed.filter("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("members"), F.min("id").alias("first_id")).filter("members > 1")
