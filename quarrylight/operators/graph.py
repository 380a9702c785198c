"""Bounded expansion and closure over an edge table."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only for a local master, where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder; the frame is computed once."""
    _shared(df.sparkSession)
    held = df.persist()  # the checkpoint is a job of its own, which would compute everything again
    out = held.checkpoint()
    held.unpersist()
    return out


@contextmanager
def holding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that keeps frames which are read several times, until the block ends; what is lost of them is computed again."""
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    try:
        yield keep
    finally:
        for df in held:
            df.unpersist()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def closure(edges: DataFrame, starts: DataFrame, source: str, target: str, node: str, depth: int | None = None) -> DataFrame:
    """(root, node, level): what each start reaches, at its smallest level, in at most ``depth`` steps if given; roots lead to themselves at level 0.

    Breadth first: each round joins only the pairs found last, and drops those known.
    """
    step = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).filter(F.col("_from").isNotNull() & F.col("_to").isNotNull()).distinct()
    front = checkpoint(starts.select(F.col(node).alias("root"), F.col(node).alias("node")).distinct())
    seen = front.withColumn("level", F.lit(0))
    level = 0
    while depth is None or level < depth:
        level += 1
        fresh = front.join(step, front["node"] == step["_from"]).select("root", F.col("_to").alias("node")).distinct()
        front = checkpoint(fresh.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("level", F.lit(level)))
    return seen


def expand(edges: DataFrame, start: Column | int, source: str, target: str, kind: str, kinds: list[str] | None = None, incoming: list[str] | None = None, depth: int = 1, max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (id, level), edges (source, target, kind, dangling) around a start, and whether a cap cut them.

    Follows edges of the given kinds forwards, and of the ``incoming`` kinds
    backwards.  Under caps, nodes are taken level by level in id order and
    edges in (level, source, target, kind) order; an edge is dangling when the
    node cap left out one of its ends.  Each edge is given once.
    """
    spark = edges.sparkSession
    depth = min(max(depth, 1), 10)
    e = edges.select(F.col(source).alias("source"), F.col(target).alias("target"), F.col(kind).alias("kind")).filter("source is not null and target is not null").distinct()
    forward = e.filter(F.col("kind").isin(kinds)) if kinds else e
    backward = e.filter(F.col("kind").isin(incoming or ["calls"]))
    nodes = spark.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0).alias("level"))
    found, front = None, nodes.select("id")
    for level in range(1, depth + 1):
        out = forward.join(front.withColumnRenamed("id", "source"), "source", "left_semi")
        back = backward.join(front.withColumnRenamed("id", "target"), "target", "left_semi")
        near = checkpoint(out.unionByName(back).distinct().withColumn("level", F.lit(level)))
        found = near if found is None else found.unionByName(near)
        ends = near.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        front = checkpoint(ends.join(nodes.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        nodes = nodes.unionByName(front.withColumn("level", F.lit(level)))
    once = found.groupBy("source", "target", "kind").agg(F.min("level").alias("level"))
    cut = False
    if max_nodes is not None:
        cut = nodes.count() > max_nodes
        nodes = nodes.orderBy("level", "id").limit(max_nodes)
    if max_edges is not None:
        cut = cut or once.count() > max_edges
        once = once.orderBy("level", "source", "target", "kind").limit(max_edges)
    known = nodes.select(F.col("id").alias("_id"))
    ends = once.join(known, F.col("source") == F.col("_id"), "left").withColumn("_s", F.col("_id").isNotNull()).drop("_id")
    ends = ends.join(known, F.col("target") == F.col("_id"), "left").withColumn("dangling", ~(F.col("_s") & F.col("_id").isNotNull()))
    return nodes, ends.select("source", "target", "kind", "level", "dangling"), cut


def expand_many(edges: DataFrame, roots: DataFrame, source: str, target: str, kind: str, kinds: list[str] | None = None, incoming: list[str] | None = None, depth: int = 1, max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What :func:`expand` gives for one start, for all ``roots`` (root) at once: nodes (root, id, level), edges (root, source, target, kind, level, dangling) and cuts (root, cut).

    The frontier is keyed by (root, node), so a level is one round of joins
    however many roots there are.  Of each level only the first nodes and edges
    that a root's caps leave room for are kept, and a root whose nodes and edges
    both exceed their caps leaves the frontier.
    """
    depth = min(max(depth, 1), 10)
    e = edges.select(F.col(source).alias("source"), F.col(target).alias("target"), F.col(kind).alias("kind")).filter("source is not null and target is not null").distinct()
    forward = e.filter(F.col("kind").isin(kinds)) if kinds else e
    backward = e.filter(F.col("kind").isin(incoming or ["calls"]))
    front = checkpoint(roots.select(F.col("root").cast("long").alias("root")).filter("root is not null").distinct().withColumn("id", F.col("root")))
    met, nodes, found, seen_edges = front, front.withColumn("level", F.lit(0)), None, None
    counts = front.select("root", F.lit(1).cast("long").alias("nodes"), F.lit(0).cast("long").alias("edges"))
    order = {"id": ["id"], "edge": ["source", "target", "kind"]}

    def room(rows: DataFrame, cap: int | None, have: str, by: str) -> DataFrame:
        """The first rows of each root that its cap still has room for."""
        if cap is None:
            return rows
        rank = F.row_number().over(Window.partitionBy("root").orderBy(*order[by]))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= cap).join(counts, "root").filter(F.col("_rank") + F.col(have) <= cap).select(*rows.columns)

    for level in range(1, depth + 1):
        out = forward.join(front.withColumnRenamed("id", "source"), "source").select("root", "source", "target", "kind")
        back = backward.join(front.withColumnRenamed("id", "target"), "target").select("root", "source", "target", "kind")
        near = out.unionByName(back).distinct()
        near = checkpoint(near if seen_edges is None else near.join(seen_edges, ["root", "source", "target", "kind"], "left_anti"))
        ends = near.select("root", F.explode(F.array("source", "target")).alias("id")).distinct()
        front = checkpoint(ends.join(met, ["root", "id"], "left_anti"))
        kept = room(near, max_edges, "edges", "edge").withColumn("level", F.lit(level))
        found = kept if found is None else found.unionByName(kept)
        nodes = nodes.unionByName(room(front, max_nodes, "nodes", "id").withColumn("level", F.lit(level)))
        grown = lambda df, name: df.groupBy("root").agg(F.count("*").alias(name))
        counts = counts.join(grown(front, "_n"), "root", "left").join(grown(near, "_e"), "root", "left")
        counts = checkpoint(counts.select("root", (F.col("nodes") + F.coalesce("_n", F.lit(0))).alias("nodes"), (F.col("edges") + F.coalesce("_e", F.lit(0))).alias("edges")))
        if max_nodes is not None and max_edges is not None:
            front = front.join(counts.filter((F.col("nodes") <= max_nodes) | (F.col("edges") <= max_edges)).select("root"), "root", "left_semi")
        met, seen_edges = met.unionByName(front), near if seen_edges is None else seen_edges.unionByName(near)
        if front.isEmpty():
            break
    over = lambda have, cap: F.lit(False) if cap is None else F.col(have) > cap
    cuts = counts.select("root", (over("nodes", max_nodes) | over("edges", max_edges)).alias("cut"))
    known = nodes.select("root", F.col("id").alias("_id"), F.lit(True).alias("_known"))
    at = lambda df, end: df.join(known.withColumnsRenamed({"_id": end, "_known": f"_{end}"}), ["root", end], "left")
    both = at(at(found, "source"), "target").withColumn("dangling", F.col("_source").isNull() | F.col("_target").isNull())
    return nodes, both.select("root", "source", "target", "kind", "level", "dangling"), cuts


def neighbours(edges: DataFrame, node: Column | int, source: str, target: str, kind: str) -> DataFrame:
    """(source, target, kind, way): a node's distinct edges, those from it (``out``) by kind and target, then those to it (``in``) by kind and source."""
    e = edges.select(F.col(source).alias("source"), F.col(target).alias("target"), F.col(kind).alias("kind")).filter((F.col("source") == node) | (F.col("target") == node)).distinct()
    way = F.when(F.col("source") == node, "out").otherwise("in")
    return e.withColumn("way", way).orderBy(F.desc("way"), "kind", F.when(F.col("way") == "out", F.col("target")).otherwise(F.col("source")))


def outline(symbols: DataFrame, id_col: str, parent_col: str, order: list[str]) -> DataFrame:
    """(id, level, path, place): each symbol's place in the tree of its parents, by one join per level, however many there are.

    A parent that isn't there makes a root, and so does the smallest id of a
    cycle of parents; ``path`` holds the ids from the root down.
    """
    s = symbols.select(F.col(id_col).alias("id"), F.col(parent_col).alias("_parent"))
    known = s.select(F.col("id").alias("_p"))
    found = _below(s, s.join(known, s["_parent"] == known["_p"], "left").filter("_p is null").select("id"))
    missing = checkpoint(s.join(found.select("id"), "id", "left_anti"))
    if not missing.isEmpty():  # cycles, and what hangs on them
        up = closure(missing, missing.select("id"), "id", "_parent", "id")
        looped = missing.join(up, (missing["_parent"] == up["root"]) & (missing["id"] == up["node"])).select(F.col("id").alias("root"))
        heads = up.join(looped, "root", "left_semi").groupBy("root").agg(F.min("node").alias("least")).filter("root = least").select(F.col("root").alias("id"))
        cut = missing.join(heads, "id", "left_anti").unionByName(heads.select("id", F.lit(None).cast(s.schema["_parent"].dataType).alias("_parent")))
        found = found.unionByName(_below(cut, heads))
    rank = Window.partitionBy("_parent").orderBy(*order)
    places = symbols.select(F.col(id_col).alias("id"), F.col(parent_col).alias("_parent"), *[c for c in order if c not in (id_col, parent_col)]).withColumn("place", F.row_number().over(rank)).select("id", "place")
    return found.join(places, "id").select("id", "level", "path", "place")


def _below(s: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, level, path) of the roots and all below them."""
    front = out = checkpoint(roots.select("id", F.lit(0).alias("level"), F.array("id").alias("path")))
    level = 0
    while not front.isEmpty():
        level += 1
        parents = front.select(F.col("id").alias("_parent"), F.col("path").alias("_path"))
        front = checkpoint(s.join(parents, "_parent").select("id", F.lit(level).alias("level"), F.array_append("_path", F.col("id")).alias("path")))
        out = out.unionByName(front)
    return out
