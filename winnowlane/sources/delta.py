"""A keyed table as a log of deltas in hash buckets: small writes, batches that count once, merged as it is read.

A put writes its rows alone, dealt to buckets by key, and then names them in the log: a numbered entry, written whole
under another name and renamed. An entry also says whose batch it is (writer and number), so a batch that comes again,
after a crash or a lost acknowledgement, changes nothing. Reading takes the last row of each key; what no delta touches is
read as it is. Compaction writes the merged table as one entry, in which earlier ones end.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN = ("_seq", "_gone", "_bucket")


class DeltaTable:
    """A table under a folder, by one key column. One writer at a time commits; another's entry of the same number is refused.

    Rows with a null key are one key. Columns may come and go: what a row's batch didn't have is null. ``buckets`` is fixed when the
    table is made. Renaming onto a taken name must fail, as on HDFS; on object stores that copy it doesn't, there give each table one writer.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "id", buckets: int = 32):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        log = self.log()
        self.buckets = log[-1]["buckets"] if log else buckets

    def log(self) -> list[dict]:
        """Entries from the last compaction on, in order: as many as puts since then."""
        where = self._hadoop.Path(f"{self.root}/log")
        if not self._fs.exists(where):
            return []
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(where) if not s.getPath().getName().startswith(".")), reverse=True)
        out = []
        for name in names:
            stream = self._fs.open(self._hadoop.Path(f"{self.root}/log/{name}"))
            try:
                out.append(json.loads(stream.readUTF()) | {"seq": int(name)})
            finally:
                stream.close()
            if out[-1]["whole"]:
                break
        return out[::-1]

    def last_batch(self, writer: str) -> int | None:
        """The number of the last batch of a writer."""
        for entry in self.log()[::-1]:
            if writer in entry["batches"]:
                return entry["batches"][writer]
        return None

    def put(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Rows take the place of those with their key; of rows that repeat a key one is kept. False if the batch was there already."""
        return self._commit(rows.dropDuplicates([self.key]).withColumn("_gone", F.lit(False)), writer, batch)

    def delete(self, keys: DataFrame, writer: str, batch: int) -> bool:
        return self._commit(keys.select(self.key).distinct().withColumn("_gone", F.lit(True)), writer, batch)

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _commit(self, rows: DataFrame, writer: str, batch: int) -> bool:
        clash = {"_seq", "_bucket"} & set(rows.columns)
        if clash:
            raise ValueError(f"columns {sorted(clash)} exist already")
        log, last = self.log(), self.last_batch(writer)
        if last is not None and batch <= last:
            return False
        self._name(self._written(rows), (log[-1]["seq"] if log else 0) + 1, {writer: batch}, False)
        return True

    def _written(self, rows: DataFrame) -> str:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(F.col(self.key))).repartition("_bucket")
        dealt.write.partitionBy("_bucket").parquet(folder)
        return folder

    def _name(self, folder: str, seq: int, batches: dict[str, int], whole: bool) -> None:
        draft = self._hadoop.Path(f"{self.root}/log/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.writeUTF(json.dumps({"folder": folder, "batches": batches, "whole": whole, "buckets": self.buckets}))
        stream.close()
        final = self._hadoop.Path(f"{self.root}/log/{seq:012d}")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer of {self.root} came first")

    def read(self, log: list[dict] | None = None, only=None) -> DataFrame | None:
        """The table as it is now; None before the first batch. ``only``: a condition on _bucket, so that others aren't read."""
        log = self.log() if log is None else log
        if not log:
            return None

        def entry(e: dict) -> DataFrame:
            found = self._frame(e["folder"])
            return (found if only is None else found.where(only)).withColumn("_seq", F.lit(e["seq"]))

        base, deltas = (log[0], log[1:]) if log[0]["whole"] else (None, log)
        if not deltas:
            return entry(base).drop(*_OWN)
        new = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(entry, deltas))
        nth = F.row_number().over(Window.partitionBy(self.key).orderBy(F.col("_seq").desc()))
        new = new.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
        live = new.where("NOT _gone").drop(*_OWN)
        if base is None:
            return live
        touched = new.select(F.col(self.key).alias("_key"))
        old = entry(base)
        return old.join(touched, old[self.key].eqNullSafe(touched["_key"]), "left_anti").drop(*_OWN).unionByName(live, allowMissingColumns=True)

    def _frame(self, folder: str) -> DataFrame:
        try:
            return self.spark.read.parquet(folder)
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        # an entry of no rows has no files
        return self.spark.createDataFrame([], f"`{self.key}` long, _gone boolean, _bucket int")

    def get(self, key) -> DataFrame | None:
        """Rows of one key; only its bucket is read."""
        log = self.log()
        if not log:
            return None
        value = F.lit(key).cast(self.read(log).schema[self.key].dataType)  # hashes differ by type
        return self.read(log, F.col("_bucket") == self._bucket(value)).where(F.col(self.key).eqNullSafe(value))

    def compact(self) -> None:
        """One entry in place of all; it knows the last batch of every writer. Folders of earlier ones stay for readers of before."""
        log = self.log()
        if len(log) < 2:
            return
        batches: dict[str, int] = {}
        for e in log:
            batches |= e["batches"]
        self._name(self._written(self.read(log).withColumn("_gone", F.lit(False))), log[-1]["seq"] + 1, batches, True)

    def clean(self) -> int:
        """Remove folders that no entry in force names: those before the last compaction, and of batches that never were named. How many went."""
        named = {e["folder"].rsplit("/", 1)[-1] for e in self.log()}
        where = self._hadoop.Path(f"{self.root}/data")
        old = [s.getPath() for s in self._fs.listStatus(where) if s.getPath().getName() not in named] if self._fs.exists(where) else []
        for path in old:
            self._fs.delete(path, True)
        return len(old)
