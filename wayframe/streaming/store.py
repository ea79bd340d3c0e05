"""Versioned tables that change together: state, results and checkpoint of one cycle are committed at once.

A cycle writes its tables under a new version; a small file, put in place by one rename, makes
the version count. What a failed cycle left has no such file, is never read, and is replaced by the
next attempt. Files are reached through Hadoop's file systems, so the folder may be on any of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another worker committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Committed versions in order."""
        folder = self._at("_commits")
        if not self._fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def checkpoint(self) -> dict:
        """What the last commit says; empty before the first."""
        found = self.versions()
        if not found:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/_commits/{found[-1]}", wholetext=True).first()[0])

    def read(self, table: str) -> DataFrame | None:
        """A table as of the last commit."""
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}/{table}") if found else None

    def read_all(self, table: str) -> DataFrame | None:
        """The rows that all commits added."""
        found = self.versions()
        return self.spark.read.parquet(*[f"{self.path}/v{n}/{table}" for n in found]) if found else None

    def commit(self, tables: dict[str, DataFrame], checkpoint: dict) -> int:
        """Writes the next version and makes it count; raises ``Conflict`` if it exists by then."""
        version = (self.versions() or [0])[-1] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        draft, final = self._at(f"_drafts/{uuid.uuid4().hex}"), self._at(f"_commits/{version}")
        self._fs.mkdirs(self._at("_commits"))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(checkpoint).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise Conflict(f"version {version} is committed already")
        return version
