"""A stored index of trigrams, for names that contain a text."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.layers import Layers
from quarrylight.sources.manifest import Manifests

POSTINGS = "gram string, id bigint"


def grams(name: Column) -> Column:
    """The distinct runs of three characters of a name in lower case; a name with fewer has none."""
    low = F.lower(name)
    places = F.sequence(F.lit(1), F.length(low) - 2)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def needed(pattern: str) -> list[str]:
    """The trigrams that every name has which contains the pattern; ``%`` and ``_`` are wildcards, a backslash takes the next as it is."""
    runs, now, left = [], "", pattern.lower()
    while left:
        if m := re.match(r"\\(.)", left, re.S):
            now += m[1]
            left = left[2:]
            continue
        if left[0] in "%_":
            runs.append(now)
            now = ""
        else:
            now += left[0]
        left = left[1:]
    return sorted({run[i : i + 3] for run in [*runs, now] for i in range(len(run) - 2)})


class GramIndex:
    """Names with a bigint id below a root; a commit writes the postings of the names it is given."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, self.root)
        self.layers = Layers(self.manifests, self.root, POSTINGS, "id", by="gram", order=["gram", "id"])

    def commit(self, names: DataFrame, id_col: str, name_col: str, removed: DataFrame | None = None) -> int:
        """A version in which ``names`` have taken the place of what it had by their ids, and ``removed`` (id) are gone."""
        base = self.manifests.version()
        held, at = self.manifests.read(base).get("postings", []), f"segments/{base + 1}-{uuid.uuid4().hex}"
        own = names.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).alias("name")).filter("id is not null")
        gone = None
        if held:
            gone = own.select("id") if removed is None else own.select("id").unionByName(removed.select(F.col(removed.columns[0]).cast("long").alias("id")))
        posted = own.select("id", F.explode(grams(F.col("name"))).alias("gram"))
        return self.manifests.publish({"postings": self.layers.merged([*held, self.layers.write(posted.distinct(), at, base + 1, gone)], f"{at}-merged")}, base + 1)

    def candidates(self, pattern: str) -> DataFrame | None:
        """(id) of the names that have all trigrams of the pattern; None where it has none, and every name is a candidate.

        Only the folders of these trigrams are read.  The rarest one's ids are met
        with the next rarest's, and so on.
        """
        wanted = needed(pattern)
        if not wanted:
            return None
        rows = self.layers.visible(self.manifests.read().get("postings", []), wanted)
        counts = {r["gram"]: r["n"] for r in rows.groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row for each trigram of the pattern
        of = lambda gram: rows.filter(F.col("gram") == gram).select("id")
        rarest = sorted(wanted, key=lambda g: (counts.get(g, 0), g))
        out = of(rarest[0])
        for gram in rarest[1:] if counts.get(rarest[0]) else []:
            out = out.join(of(gram), "id", "left_semi")
        return out

    def containing(self, names: DataFrame, pattern: str, id_col: str, name_col: str) -> DataFrame:
        """Rows of ``names`` (those that were committed) whose name contains the pattern, whatever the case; the candidates are verified.

        A pattern without three characters in a row is held against every name.
        """
        found = self.candidates(pattern)
        rows = names if found is None else names.join(found.withColumnRenamed("id", id_col), id_col, "left_semi")
        return rows.filter(F.col(name_col).ilike(f"%{pattern}%"))
