"""Token counts as delta-maintained rollups.

Inserts, deletes and revised counts become signed changes, summed by source, language and
tokenizer version before they are stored. A batch is committed once: its sums are written to a
folder of their own, a marker that names it is written whole under a name of no account, and then renamed
to the batch's; renaming fails if the batch has a marker already. So a crash at any point leaves the batch
committed or not, nothing between. Totals add up the committed folders only; so retries and
lost executors change nothing. compact() puts the sums of all batches into one folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"


def word_tokens(text: Column) -> Column:
    """Tokenizer words-1: runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def letter_tokens(text: Column) -> Column:
    """Tokenizer words-2: runs of ASCII letters or digits, and every other character but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")), F.lit(0)).cast("long")


def byte_tokens(text: Column) -> Column:
    """Tokenizer bytes-1: a token for each byte of UTF-8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bpe_tokens(docs: DataFrame, path: str, version: str) -> DataFrame:
    """source, lang, tokenizer_version and n of each whole text under a public BPE vocabulary file."""
    from winnowlane.llm import bpe

    plain = docs.select("source", "lang", "text")
    return bpe.encode(plain, path).select("source", "lang", F.lit(version).alias("tokenizer_version"), F.col("n_tokens").alias("n"))


def counted(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Signed changes of documents whose tokens are counted already: rows of source, lang, tokenizer_version, n."""
    return rows.select("source", "lang", "tokenizer_version", F.lit(sign).cast("long").alias("docs"), (sign * F.col("n")).alias("tokens"))


def _changes(docs: DataFrame, counts: dict[str, Column], sign: int) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), c.alias("n")) for v, c in counts.items()])
    flat = docs.select("source", "lang", F.explode(rows).alias("r"))
    return flat.select("source", "lang", "r.tokenizer_version", F.lit(sign).cast("long").alias("docs"), (sign * F.col("r.n")).alias("tokens"))


def inserts(docs: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Signed changes of documents that arrive, for each tokenizer version and its count column."""
    return _changes(docs, counts, 1)


def deletes(docs: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Signed changes of documents that go; the counts must be those they came with."""
    return _changes(docs, counts, -1)


def revisions(docs: DataFrame, old: dict[str, Column], new: dict[str, Column]) -> DataFrame:
    """Old counts go and new ones come, in one batch and one pass."""
    signed = [(v, c, -1) for v, c in old.items()] + [(v, c, 1) for v, c in new.items()]
    rows = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.lit(s).cast("long").alias("docs"), (s * c).alias("tokens")) for v, c, s in signed])
    return docs.select("source", "lang", F.explode(rows).alias("r")).select("source", "lang", "r.*")


class TokenRollup:
    """Totals by source, language and tokenizer version under a folder that all executors share.

    A null source or language is a group of its own. A group whose documents all went has no row. Each row
    of a batch counts, rows that repeat a document too; an empty batch is committed and changes nothing; a
    null text has no tokens, and a text counts whole however long it is. Other columns are not looked at.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marker(self, batch_id: str):
        if not batch_id or batch_id.startswith(".") or any(c in batch_id for c in "/:"):
            raise ValueError("a batch id must be a file name")
        return self._hadoop.Path(f"{self.path}/commits/{batch_id}")

    def committed(self) -> dict[str, str]:
        """The folder of each committed batch; a batch whose sums a compaction holds has none of its own ('')."""
        where = self._hadoop.Path(f"{self.path}/commits")
        if not self._fs.exists(where):
            return {}
        out = {}
        for s in self._fs.listStatus(where):
            if s.getPath().getName().startswith("."):
                continue
            stream = self._fs.open(s.getPath())
            try:
                out[s.getPath().getName()] = stream.readUTF()
            finally:
                stream.close()
        folder, held = self._compacted()
        return out | dict.fromkeys(held & set(out), "") | ({"": folder} if folder else {})

    def _compacted(self) -> tuple[str, set[str]]:
        """Folder and batches of the latest compaction: the greatest number among those written whole."""
        where = self._hadoop.Path(f"{self.path}/compactions")
        found = sorted((s.getPath() for s in self._fs.listStatus(where)), key=lambda p: p.getName()) if self._fs.exists(where) else []
        found = [p for p in found if not p.getName().startswith(".")]
        if not found:
            return "", set()
        stream = self._fs.open(found[-1])
        try:
            folder, *batches = [stream.readUTF() for _ in range(stream.readInt())]
        finally:
            stream.close()
        return folder, set(batches)

    def _name(self, marker, write) -> bool:
        """A file made whole or not at all; False if its name is taken. Renaming to a name that exists is refused by the file system."""
        draft = self._hadoop.Path(marker.getParent(), f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        write(stream)
        stream.close()
        try:
            done = not self._fs.exists(marker) and self._fs.rename(draft, marker)
        except Exception:
            done = False
            if not self._fs.exists(marker):
                raise
        if not done:
            self._fs.delete(draft, False)
        return done

    def compact(self) -> int:
        """Sum all committed batches into one folder, and say so in one file; the number of batches it holds.

        Totals stay what they are at every point: folders of batches are left where they are, so a
        reader of before is not disturbed; old_folders() names what may then be removed.
        """
        now = self.committed()
        batches = sorted(b for b in now if b)
        folder = f"{self.path}/deltas/compacted-{uuid.uuid4().hex}"
        self._summed(now).where("docs != 0 OR tokens != 0").write.parquet(folder)

        def write(stream) -> None:
            stream.writeInt(1 + len(batches))
            for x in (folder, *batches):
                stream.writeUTF(x)

        where = self._hadoop.Path(f"{self.path}/compactions")
        n = len(self._fs.listStatus(where)) if self._fs.exists(where) else 0
        if not self._name(self._hadoop.Path(f"{self.path}/compactions/{n + 1:012d}"), write):
            raise RuntimeError("another compaction came first")
        return len(batches)

    def old_folders(self) -> list[str]:
        """Folders that no total reads: of compacted batches, and of commits that ended before their marker."""
        live = set(self.committed().values())
        where = self._hadoop.Path(f"{self.path}/deltas")
        found = [s.getPath().toString() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        names = {f.rstrip("/").rsplit("/", 1)[-1] for f in live}
        return [f for f in found if f.rstrip("/").rsplit("/", 1)[-1] not in names]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of signed changes; False, and nothing happens, if the id is committed already."""
        marker = self._marker(batch_id)
        if self._fs.exists(marker):
            return False
        folder = f"{self.path}/deltas/{batch_id}-{uuid.uuid4().hex}"
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.where("docs != 0 OR tokens != 0").write.parquet(folder)
        if not self._name(marker, lambda stream: stream.writeUTF(folder)):  # another run of this batch came first
            self._fs.delete(self._hadoop.Path(folder), True)
            return False
        return True

    def _summed(self, committed: dict[str, str]) -> DataFrame:
        folders = sorted(f for f in committed.values() if f)
        # one scan of all folders: the plan does not grow with the number of batches
        rows = self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens over all committed batches."""
        rows = self._summed(self.committed()).withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})
        return rows.where("n_docs != 0 OR n_tokens != 0")
