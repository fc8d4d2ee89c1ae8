"""Versioned Parquet tables: tables are written aside, then one small file makes them a version.

``versions/N.json`` names the folder of each table of version N; the largest N counts. The file is
written under another name and renamed to one that doesn't exist yet, which file systems do at once
or not at all, so a run that fails at any point leaves the store as it was. Tables that a version
doesn't bring along are those of the version before. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Versions whose tables are kept for readers that began with them.
KEPT = 3


class Store:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        here = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(here)) if self._fs.exists(here) else []

    def versions(self) -> list[int]:
        """The numbers of complete versions, the current one last."""
        return sorted(int(n[: -len(".json")]) for n in self._names("versions") if n.endswith(".json"))

    def version(self) -> int | None:
        """The current version; None before the first."""
        return max(self.versions(), default=None)

    def made_at(self, version: int) -> int:
        """When a version was made, in seconds."""
        return self._fs.getFileStatus(self._path(f"{self.root}/versions/{version}.json")).getModificationTime() // 1000

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Folder by table of a version, by default the current one."""
        version = self.version() if version is None else version
        if version is None:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/versions/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        """A table of the current version."""
        folder = self.tables().get(name)
        if folder is None:
            raise FileNotFoundError(f"no table {name} is stored in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Write tables, make them a new version, drop what only old versions hold."""
        old = self.version()
        named, new = dict(self.tables(old)) if old is not None else {}, (old or 0) + 1
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
            named[name] = f"{folder}/{name}"
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        beside = self._path(f"{self.root}/versions/{uuid.uuid4().hex}.part")
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(named, sort_keys=True).encode()))
        finally:
            stream.close()
        if not self._fs.rename(beside, self._path(f"{self.root}/versions/{new}.json")):
            raise OSError(f"version {new} of {self.root} could not be made")
        self._clean()
        return new

    def _clean(self) -> None:
        versions = self.versions()
        held = {f.split("/")[1] for v in versions[-KEPT:] for f in self.tables(v).values()}
        for v in versions[:-KEPT]:
            self._fs.delete(self._path(f"{self.root}/versions/{v}.json"), False)
        for name in self._names("data"):
            if name not in held:
                self._fs.delete(self._path(f"{self.root}/data/{name}"), True)

    def size(self) -> int:
        """Bytes of all versions."""
        here = self._path(self.root)
        return self._fs.getContentSummary(here).getLength() if self._fs.exists(here) else 0
