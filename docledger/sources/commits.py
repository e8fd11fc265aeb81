"""Several tables that change together: a commit writes their new folders, then one manifest that names them all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit came first."""


class Tables:
    """Tables under one path, in versions. Version n is the manifest n.json, which names a folder for each table.

    A commit writes folders that no manifest names yet, and then puts the next manifest in place under a name that must not
    exist: whoever comes second gets a Conflict and has to start from the new version. So readers see all tables of a commit
    or none, and a writer that fails anywhere leaves them on the old version. The manifest is renamed into place
    without overwriting, which is atomic on HDFS; other stores have to offer the same.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.path}/manifests"))

    def version(self) -> int:
        """The latest version, 0 before the first commit."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/manifests"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first().value)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        folders = self.folders(self.version() if version is None else version)
        return {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in folders.items()}

    def commit(self, changes: dict[str, DataFrame], based_on: int) -> int:
        """Puts new states of some tables in place, the others stay; only if `based_on` is still the latest version."""
        folders = self.folders(based_on)
        for name, rows in changes.items():
            folders[name] = f"{name}/{uuid.uuid4().hex}"
            rows.write.mode("errorifexists").parquet(f"{self.path}/{folders[name]}")
        self._place(based_on + 1, json.dumps(folders))
        return based_on + 1

    def _place(self, version: int, text: str) -> None:
        ready = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(ready)
        out.write(bytearray(text.encode()))
        out.close()
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(ready, self._path(f"{self.path}/manifests/{version}.json"), plain)
        except Py4JJavaError as failed:
            self.fs.delete(ready, False)
            if "FileAlreadyExists" in str(failed.java_exception):
                raise Conflict(f"version {version} is already there") from None
            raise

    def update(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], attempts: int = 5) -> int:
        """Applies a change to the latest tables, again from the start if another commit comes first."""
        for attempt in range(attempts):
            latest = self.version()
            try:
                return self.commit(change(self.read(latest)), latest)
            except Conflict:
                if attempt + 1 == attempts:
                    raise
        raise ValueError("attempts has to be at least 1")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drops folders that none of the last versions names, with their manifests; returns them. Not beside a running commit."""
        latest = self.version()
        kept = {f for v in range(max(1, latest - keep + 1), latest + 1) for f in self.folders(v).values()}
        gone = []
        for table in self.fs.listStatus(self._path(self.path)):
            if table.getPath().getName() != "manifests":
                for folder in self.fs.listStatus(table.getPath()):
                    name = f"{table.getPath().getName()}/{folder.getPath().getName()}"
                    if name not in kept:
                        self.fs.delete(folder.getPath(), True)
                        gone.append(name)
        for v in range(1, latest - keep + 1):
            self.fs.delete(self._path(f"{self.path}/manifests/{v}.json"), False)
        return gone
