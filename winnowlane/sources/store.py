"""Keyed tables on a file system: reads, upserts, deletes, snapshots. A write makes a new version, then names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables under a folder. A version is a Parquet folder; a small text file says which one holds.

    Readers of the version before are not disturbed. One writer at a time is assumed for a table.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, name: str) -> str | None:
        found = self._pointers(name)
        if not found:
            return None
        stream = self._fs.open(found[0])
        try:
            return stream.readUTF() or None
        finally:
            stream.close()

    def all(self, name: str) -> DataFrame | None:
        v = self.version(name)
        return None if v is None else self.spark.read.parquet(v)

    def get(self, name: str, key) -> DataFrame | None:
        t = self.all(name)
        return None if t is None else t.where(F.col(self.key) == F.lit(key))

    def keys(self, name: str) -> DataFrame | None:
        t = self.all(name)
        return None if t is None else t.select(self.key)

    def replace(self, name: str, rows: DataFrame) -> str:
        folder = f"{self.root}/{name}/v-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self._name(name, folder)
        return folder

    def _pointers(self, name: str) -> list:
        """Pointer files of a table, the latest first. Files of a name with a dot are not finished."""
        where = self._hadoop.Path(f"{self.root}/{name}/current")
        if not self._fs.exists(where):
            return []
        found = [s.getPath() for s in self._fs.listStatus(where) if not s.getPath().getName().startswith(".")]
        return sorted(found, key=lambda p: p.getName(), reverse=True)

    def _name(self, name: str, folder: str) -> None:
        """Say which version holds: a numbered file, written whole under another name and renamed. A crash leaves the version before."""
        before = self._pointers(name)
        n = int(before[0].getName()) + 1 if before else 1
        draft = self._hadoop.Path(f"{self.root}/{name}/current/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.writeUTF(folder)
        stream.close()
        if not self._fs.rename(draft, self._hadoop.Path(f"{self.root}/{name}/current/{n:012d}")):
            raise RuntimeError(f"another writer of {name} came first")
        for old in before[1:]:
            self._fs.delete(old, False)

    def put(self, name: str, rows: DataFrame) -> str:
        """Rows take the place of those with their key; of rows that repeat a key one is kept."""
        rows = rows.dropDuplicates([self.key])
        old = self.all(name)
        if old is None:
            return self.replace(name, rows)
        return self.replace(name, old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete(self, name: str, keys: DataFrame) -> str | None:
        old = self.all(name)
        return None if old is None else self.replace(name, old.join(keys.select(self.key), self.key, "left_anti"))

    def clear(self, name: str) -> None:
        """The table is empty of versions; their folders stay, so restore() can bring one back."""
        self._name(name, "")

    def restore(self, name: str, version: str) -> None:
        """Make an earlier version hold again."""
        self._name(name, version)
