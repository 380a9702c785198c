"""Paths: children of a directory, probing candidates, unique suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def children(paths: DataFrame, path: str, prefix: str = "") -> DataFrame:
    """(name, is_dir) of what lies right below a prefix, directories first."""
    base = prefix.rstrip("/") + "/" if prefix.strip("/") else ""
    rest = F.substring(F.col(path), F.lit(len(base) + 1), F.length(path))
    below = paths.filter(F.col(path).startswith(base) & (F.length(path) > len(base))) if base else paths.filter(F.length(path) > 0)
    parts = below.select(F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir")).filter("name <> ''")
    return parts.groupBy("name").agg(F.max("is_dir").alias("is_dir")).orderBy(F.desc("is_dir"), "name")


def ignored(name: Column, patterns: list[str]) -> Column:
    """Exact names, and ``*suffix`` patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | (name.endswith(p[1:]) if p.startswith("*") else name == p)
    return out


def probe_first(rows: DataFrame, candidates: str, known: DataFrame, path: str, key: str, value: str) -> DataFrame:
    """(key, value, probe): the first candidate path that is known, and its place; one equi-join."""
    probes = rows.select(F.col(key), F.posexplode(candidates).alias("_pos", "_path"))
    hits = probes.join(known.select(F.col(path).alias("_path"), F.col(value).alias("_value")), "_path")
    return hits.groupBy(key).agg(F.min_by("_value", F.struct("_pos", "_value")).alias(value), F.min("_pos").alias("probe"))


def suffixes(path: Column) -> Column:
    """The path and everything after each of its slashes."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def unique_suffix(names: DataFrame, name: str, known: DataFrame, path: str, value: str) -> DataFrame:
    """(name, value) where exactly one known path ends in the name; only wanted suffixes are kept of the many."""
    wanted = names.select(F.col(name).alias("_suffix")).distinct()
    listed = known.select(F.col(value).alias("_value"), F.explode(suffixes(F.col(path))).alias("_suffix")).join(wanted, "_suffix")
    one = listed.groupBy("_suffix").agg(F.count("*").alias("_n"), F.min("_value").alias("_value")).filter("_n = 1")
    return one.select(F.col("_suffix").alias(name), F.col("_value").alias(value))
