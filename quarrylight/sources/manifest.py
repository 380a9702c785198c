"""Numbered manifests: small JSON files that name what a version consists of."""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Manifests:
    """The versions below a root, through Spark's own file system; of two writers of one version the second fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.at = spark, f"{root.rstrip('/')}/manifests"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 before the first."""
        folder = self._path(self.at)
        names = [s.getPath().getName() for s in (self._fs.listStatus(folder) if self._fs.exists(folder) else [])]
        return max((int(n[: -len(".json")]) for n in names if n.endswith(".json")), default=0)

    def read(self, version: int | None = None) -> dict:
        """What a version holds; nothing for version 0."""
        version = self.version() if version is None else version
        if not version:
            return {}
        for left in range(50, -1, -1):  # its writer may not have closed it yet
            try:
                stream = self._fs.open(self._path(f"{self.at}/{version}.json"))
                try:
                    return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
            except (Py4JJavaError, json.JSONDecodeError):
                if not left:
                    raise
                time.sleep(0.1)
        raise AssertionError

    def create(self, at: str, text: str) -> None:
        """Writes a new file; an error where it is there."""
        stream = self._fs.create(self._path(at), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def exists(self, pattern: str) -> bool:
        """Whether a file is there whose path is like a pattern."""
        return bool(self._fs.globStatus(self._path(pattern)))

    def publish(self, content: dict, new: int) -> int:
        """Makes ``content`` the version ``new``: its file is created, which fails where it is there."""
        try:
            self.create(f"{self.at}/{new}.json", json.dumps(content))
        except Py4JJavaError as error:
            raise RuntimeError(f"version {new} was written by someone else") from error
        return new

    def size(self, at: str) -> int:
        """Bytes of the files below a folder; 0 where there is none."""
        folder = self._path(at)
        return self._fs.getContentSummary(folder).getLength() if self._fs.exists(folder) else 0
