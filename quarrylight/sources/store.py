"""The tables on disk: Parquet directories that a versioned manifest names.

A write goes to new directories; only when they are whole does a new manifest
name them, so readers see the old tables or the new, and a lost executor or a
failed job leaves the current version alone.  What a write doesn't touch is not
copied: the manifest goes on naming the old directories.  A workspace's part of
a table has layers of its own (see :mod:`quarrylight.sources.layers`): a commit
compares its rows file by file with those that are visible and writes the files
that differ beside them, so a change costs bytes in proportion to itself.
Every commit writes below a name of its own, so of two writers at once the one
that comes second fails and harms nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import schema
from quarrylight.operators import dedupe, diff
from quarrylight.sources.jobs import JobLog
from quarrylight.sources.layers import Layers, replaced
from quarrylight.sources.manifest import Manifests

#: Tables that are split by workspace on disk, and the column whose rows change together.
BY_WORKSPACE = {
    "file": "id", "file_content": "file_id", "symbol": "file_id", "occurrence": "file_id", "reference": "file_id",
    "relation": "source_symbol_id", "dependency": "source_file_id", "diagnostic": "file_id",
    "candidate_set": "set_id",
}
ALL = "*"
#: Directories of added rows that a table may have before they are made one.
MAX_PARTS = 64


class Store:
    """Named tables below a root, through Spark's own file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, self.root)

    def version(self) -> int:
        """The current version; 0 before the first."""
        return self.manifests.version()

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """Table to workspace (or all) to what holds its rows: layers, or a directory."""
        return self.manifests.read(version)

    def layers(self, name: str) -> Layers:
        """How a workspace's part of a split table is written and read."""
        return Layers(self.manifests, self.root, schema.columns(name), BY_WORKSPACE[name])

    def table(self, name: str, version: int | None = None, workspaces: list[int] | None = None, keys: list | None = None) -> DataFrame:
        """A table as of a version; of some ``workspaces`` alone, and of some ``keys`` (files, as a rule), only their parts are read."""
        parts = self.manifest(version).get(name, {})
        out = schema.empty(self.spark, name)
        own = [int(k) for k in parts if k != ALL and not k.startswith("+")]
        split = name in BY_WORKSPACE
        for key, at in sorted(parts.items()):
            if isinstance(at, list):
                if workspaces is not None and int(key) not in workspaces:
                    continue
                df = self.layers(name).visible(at, keys)
            else:
                df = self.spark.read.schema(schema.columns(name)).parquet(f"{self.root}/{at}")
                if key == ALL and own:
                    df = df.filter(~F.col("workspace_id").isin(own))
                if workspaces is not None and split:
                    df = df.filter(F.col("workspace_id").isin(workspaces))
                if keys is not None and split:
                    df = df.filter(F.col(BY_WORKSPACE[name]).isin(keys))
            out = out.unionByName(df)
        return out

    def commit(self, tables: dict[str, DataFrame], workspace: int | None = None, added: dict[str, DataFrame] | None = None, base: int | None = None, whole: dict[str, DataFrame] | None = None) -> int:
        """A new version with these tables; of a split table only the workspace's rows, where one is given.

        ``added`` holds rows that join those of tables that aren't split, ``whole``
        tables that aren't split beside a workspace's; ``base`` is the version that
        the rows were made from, after which no other may have come.
        """
        base = self.version() if base is None else base
        manifest, new, own = self.manifest(base), base + 1, f"data/{base + 1}-{uuid.uuid4().hex}"
        split = {name: df for name, df in tables.items() if workspace is not None and name in BY_WORKSPACE}
        key = str(workspace)
        if split:
            held = {name: manifest.get(name, {}).get(key, []) for name in split}
            made = replaced({name: (self.layers(name), held[name], df, f"{own}/{name}/{key}") for name, df in split.items()}, new)
            manifest |= {name: manifest.get(name, {}) | {key: layers} for name, layers in made.items()}
        for name, df in (tables | (whole or {})).items():
            if name not in split:
                self._write(name, df, f"{own}/{name}")
                manifest[name] = {ALL: f"{own}/{name}"}
        for name, df in (added or {}).items():
            self._write(name, df, f"{own}/{name}+")
            manifest[name] = manifest.get(name, {}) | {f"+{new}": f"{own}/{name}+"}
        return self.manifests.publish(manifest, new)

    def _write(self, name: str, df: DataFrame, at: str) -> None:
        df.select(*(f.split()[0] for f in _fields(name))).write.parquet(f"{self.root}/{at}")

    def append(self, name: str, rows: DataFrame) -> int:
        """Adds rows; what a table holds already is written anew only when its parts are many, or split by workspace."""
        if name in BY_WORKSPACE or len(self.manifest().get(name, {})) >= MAX_PARTS:
            at = self.version()
            return self.commit({name: self.table(name, at).unionByName(rows)}, base=at)
        return self.commit({}, added={name: rows})

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> int:
        at = self.version()
        return self.commit({name: diff.upsert(self.table(name, at), rows, key)}, base=at)

    def insert_missing(self, name: str, rows: DataFrame, key: list[str]) -> int:
        at = self.version()
        return self.commit({name: diff.insert_missing(self.table(name, at), rows, key)}, base=at)

    def delete_workspace(self, workspace_id: int) -> int:
        """A workspace with everything that hangs on it; its parts of split tables are forgotten, not rewritten."""
        at = self.version()
        manifest, new, own = self.manifest(at), at + 1, f"data/{at + 1}-{uuid.uuid4().hex}"
        for name, parts in manifest.items():
            if name in BY_WORKSPACE:
                manifest[name] = parts | {str(workspace_id): []}  # hides rows of a directory for all, too
                continue
            df = self.table(name, at)
            if name == "workspace":
                kept = df.filter(F.col("id") != workspace_id)
            elif name == "workspace_link":
                kept = df.filter((F.col("source") != workspace_id) & (F.col("target") != workspace_id))
            elif "workspace_id" in schema.TABLES[name]:
                kept = df.filter(F.col("workspace_id") != workspace_id)
            else:
                continue
            self._write(name, kept, f"{own}/{name}")
            manifest[name] = {ALL: f"{own}/{name}"}
        return self.manifests.publish(manifest, new)

    @property
    def log(self) -> JobLog:
        return JobLog(self.spark, self.root)

    def latest_jobs(self, workspace_id: int, limit: int = 20, job: int | None = None) -> DataFrame:
        """The newest state of each job, from the table of those that came through and the log of the others."""
        jobs = self.table("index_job").unionByName(self.log.rows()).filter(F.col("workspace_id") == workspace_id)
        jobs = jobs.filter(F.col("id") == job) if job is not None else jobs
        newest = jobs.groupBy("id").agg(F.max_by(F.struct(*[c for c in jobs.columns if c != "id"]), "at").alias("_r")).select("id", "_r.*")
        return newest.orderBy(F.desc("at"), "id").limit(limit)

    def cancel(self, job: int, workspace_id: int) -> bool:
        """Asks a run to stop; false where the job isn't known or has ended."""
        row = self.latest_jobs(workspace_id, 1, job).first()
        if row is None or row["status"] in schema.JOB_ENDS:
            return False
        self.log.cancel(job, workspace_id, row["job_type"])
        return True


def last_wins(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """Of the rows of a key the one written last."""
    return dedupe.first_by(rows.withColumn("_order", -F.col(sequence)), key, ["_order"]).drop("_order")


def _fields(name: str) -> list[str]:
    depth, out, now = 0, [], ""
    for c in schema.columns(name):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
