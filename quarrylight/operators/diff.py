"""Snapshot differences: what to process, skip and remove, and cleaning up after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(found: DataFrame, stored: DataFrame, path: str, hash_: str, language: str | None = None, metadata: list[str] | None = None, deleted: str | None = None, force: bool = False) -> DataFrame:
    """(path, action, reason) of every path that either side has, by one full outer join.

    Reasons in this order: new, recreated (was deleted), forced, content_changed,
    language_changed, metadata_changed, unchanged; a stored path that wasn't
    found is missing, unless it was deleted already.
    """
    columns = [hash_, *([language] if language else []), *(metadata or [])]
    f = found.select(F.col(path).alias("path"), F.lit(True).alias("_f"), *(F.col(c).alias(f"_f_{c}") for c in columns))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    s = stored.select(F.col(path).alias("path"), F.lit(True).alias("_s"), gone.alias("_gone"), *(F.col(c).alias(f"_s_{c}") for c in columns))
    differs = lambda c: ~F.col(f"_f_{c}").eqNullSafe(F.col(f"_s_{c}"))
    reason = F.when(F.col("_f").isNull() & F.col("_gone"), None).when(F.col("_f").isNull(), "missing").when(F.col("_s").isNull(), "new").when(F.col("_gone"), "recreated")
    if force:
        reason = reason.when(F.lit(True), "forced")
    reason = reason.when(differs(hash_), "content_changed")
    if language:
        reason = reason.when(differs(language), "language_changed")
    for c in metadata or []:
        reason = reason.when(differs(c), "metadata_changed")
    action = F.when(F.col("reason") == "unchanged", "skip").when(F.col("reason") == "metadata_changed", "touch").when(F.col("reason") == "missing", "remove").otherwise("process")
    both = f.join(s, "path", "full_outer").withColumn("reason", reason.otherwise("unchanged")).filter("reason is not null")
    return both.select("path", action.alias("action"), "reason")


def tombstone(stored: DataFrame, keep: DataFrame, key: str, flag: str) -> DataFrame:
    """Stored rows, those whose key isn't kept flagged as deleted."""
    kept = keep.select(F.col(key)).distinct().withColumn("_kept", F.lit(True))
    joined = stored.join(kept, key, "left")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.col("_kept").isNull()).drop("_kept").select(*stored.columns)


def without_deleted(derived: DataFrame, stored: DataFrame, key: str, flag: str) -> DataFrame:
    """Derived rows whose parent is stored and not deleted."""
    return derived.join(stored.filter(~F.coalesce(F.col(flag), F.lit(False))).select(key).distinct(), key, "left_semi")


def set_null(rows: DataFrame, parents: DataFrame, column: str, parent_id: str) -> DataFrame:
    """Rows whose reference to a missing parent is nulled."""
    known = parents.select(F.col(parent_id).alias(column)).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, column, "left")
    return joined.withColumn(column, F.when(F.col("_known"), F.col(column))).select(*rows.columns)


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows take the place of stored ones of their key."""
    return stored.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def insert_missing(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows whose key isn't stored yet are added."""
    return stored.unionByName(fresh.join(stored.select(*key).distinct(), key, "left_anti"))


def forget_hashes(stored: DataFrame, hash_: str, changed: Column) -> DataFrame:
    """After a change of settings the next plan takes these files as changed."""
    return stored.withColumn(hash_, F.when(~changed, F.col(hash_)))
