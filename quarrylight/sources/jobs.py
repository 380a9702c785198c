"""The log of index runs: a small file for each state or stage of a job before its end, beside the store's versions.

States are written by the driver alone, outside Spark's jobs, so a run whose
jobs are interrupted can still say that it was.  A run carries its job's tag on
everything that it has Spark do, and looks between its stages whether somebody
asked it to stop; asking from any process is a file, and the session that runs
the job is interrupted at once besides.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import schema
from quarrylight.sources.manifest import Manifests

COUNTS = ("total", "processed", "skipped", "errors", "warnings")


class Cancelled(Exception):
    """A run was stopped before it had committed anything."""


class JobLog:
    """The jobs of a store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.at = spark, f"{root.rstrip('/')}/jobs"
        self.files = Manifests(spark, root)

    def write(self, job: int, workspace_id: int, job_type: str, status: str, stage: str | None = None, **counts: int) -> None:
        now = time.time_ns() // 1000
        row = {"id": job, "workspace_id": workspace_id, "job_type": job_type, "status": status, "stage": stage, **{k: counts.get(k, 0) for k in COUNTS}, "at": now}
        self.files.create(f"{self.at}/{now}-{job}-{status}-{uuid.uuid4().hex}.json", json.dumps(row))

    def rows(self) -> DataFrame:
        """Every state of every job, with the columns of the job table."""
        columns = schema.columns("index_job")
        if not self.files.size(self.at):
            return self.spark.createDataFrame([], columns)
        read = self.spark.read.schema(columns.replace("at timestamp", "at bigint")).json(self.at)
        return read.withColumn("at", F.timestamp_micros("at")).select(*schema.empty(self.spark, "index_job").columns)

    def cancelling(self, job: int) -> bool:
        """Whether somebody has asked a job to stop."""
        return self.files.exists(f"{self.at}/*-{job}-cancelling-*")

    def cancel(self, job: int, workspace_id: int, job_type: str = "incremental") -> None:
        """Asks a job to stop and interrupts what this session does for it."""
        self.write(job, workspace_id, job_type, "cancelling")
        self.spark.interruptTag(tag(job))


def tag(job: int) -> str:
    return f"index-job-{job}"


class Run:
    """A job while it runs, as a context: ``stage`` begins the next stage, and the end is logged whatever it is."""

    def __init__(self, log: JobLog, job: int, workspace_id: int, job_type: str):
        self.log, self.job, self.workspace_id, self.job_type = log, job, workspace_id, job_type
        self.counts: dict[str, int] = {}

    def _write(self, status: str, stage: str | None = None) -> None:
        self.log.write(self.job, self.workspace_id, self.job_type, status, stage, **self.counts)

    def __enter__(self) -> Run:
        self._write("queued")
        self.log.spark.addTag(tag(self.job))
        return self

    def stage(self, name: str) -> None:
        """Says what comes next, unless the job is asked to stop."""
        if self.log.cancelling(self.job):
            raise Cancelled(f"job {self.job}")
        self._write("running", name)

    def __exit__(self, kind, error, trace) -> None:
        self.log.spark.removeTag(tag(self.job))
        if kind is None:  # the commit holds the row of a run that came through
            return
        stopped = kind is Cancelled or self.log.cancelling(self.job)
        self._write("cancelled" if stopped else "failed")
        if stopped and kind is not Cancelled:
            raise Cancelled(f"job {self.job}") from error
