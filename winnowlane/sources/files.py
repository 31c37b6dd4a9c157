"""Folders of files as frames: scans, triage by name and first bytes, and what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnowlane.functions.text import extension

DEEPEST = 32
# Folders that the library itself writes, and what extensions stand for.
OWN_OUTPUT = r"^_(finalists|sidecars|tagged)"
IMAGES = {"jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "png": "png", "webp": "webp", "gif": "gif", "heic": "heic", "heif": "heic", "hif": "heic"}
VIDEOS = ("mp4", "mov", "m4v", "avi", "mkv", "webm", "mpg", "mpeg", "3gp", "wmv")
RAWS = ("cr2", "cr3", "nef", "arw", "dng", "raf", "orf", "rw2", "pef", "srw")
#: One schema for every source; content only where it is read.
RECORD = ("path", "name", "dir", "size", "modified")


def from_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """name and dir of relative paths."""
    p = F.regexp_replace(F.col(column), r"^/+", "")
    return paths.withColumn("path", p).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))


def wanted(path: Column) -> Column:
    """Not too deep, no dot-file or dot-folder, not in the library's own output."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return (F.size(parts) <= DEEPEST + 1) & ~F.exists(parts, lambda s: F.startswith(s, F.lit("."))) & ~F.exists(folders, lambda s: s.rlike(OWN_OUTPUT))


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (under the root), name, dir, size, modified and content of the files below a folder.

    Without ``content`` Spark lists the files and reads none. With it every listed file has a row: one that
    cannot be read has no content, and column ``err`` says so. Spark lists no files of no bytes.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # the root may come back with a scheme; what follows its last segment is the relative path
    tail = root.rstrip("/").split("://")[-1].rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), tail, -1)
    names = from_paths(listed.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))).where(wanted(F.col("path"))).select(*RECORD)
    if not content:
        return names
    lenient = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    read = lenient.select(F.regexp_replace(rel, r"^/+", "").alias("path"), "content")
    return names.join(read, "path", "left").withColumn("err", F.when(F.col("content").isNull(), F.lit("unreadable")))


def open_source(spark: SparkSession, source, content: bool = True) -> DataFrame:
    """The columns RECORD (and content and err of a folder that is read) from a folder, a list of paths or of (path, size, modified), or a frame with a path column."""
    if isinstance(source, str):
        return scan(spark, source, content)
    if not isinstance(source, DataFrame):
        rows = [(p, None, None) if isinstance(p, str) else tuple(p) for p in source]
        source = spark.createDataFrame(rows, "path string, size long, modified timestamp")
    for name, kind in (("size", "long"), ("modified", "timestamp")):
        if name not in source.columns:
            source = source.withColumn(name, F.lit(None).cast(kind))
    return from_paths(source).where(wanted(F.col("path"))).select(*RECORD)


def kind_of(name: Column) -> Column:
    """An image format, video, raw, or unknown, by extension."""
    ext = extension(name)
    out = F.when(ext.isin(*VIDEOS), "video").when(ext.isin(*RAWS), "raw")
    for k, v in IMAGES.items():
        out = out.when(ext == k, v)
    return out.otherwise("unknown")


def triage(files: DataFrame) -> DataFrame:
    """Files with kind and class: image, skipped or unknown."""
    out = files.withColumn("kind", kind_of(F.col("name")))
    return out.withColumn("class", F.when(F.col("kind").isin("video", "raw"), "skipped").when(F.col("kind") == "unknown", "unknown").otherwise("image"))


def sniff(content: Column) -> Column:
    """Format by the first bytes; null if it is none of those known."""
    head = F.hex(F.substring(content, 1, 12))
    box = F.substring(head, 17, 8)
    return (
        F.when(F.startswith(head, F.lit("FFD8FF")), "jpeg").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(head, F.lit("47494638")), "gif")
        .when(F.startswith(head, F.lit("52494646")) & (box == "57454250"), "webp")
        .when((F.substring(head, 9, 8) == "66747970") & box.isin("68656963", "68656978", "6D696631", "6D736631", "68657663"), "heic")
        .when((F.substring(head, 9, 8) == "66747970") & box.isin("61766966", "61766973"), "avif")
    )


def new_rows(found: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Found rows whose identity is not known."""
    return found.join(known.select(key), key, "left_anti")


def in_scope(rows: DataFrame, ids: DataFrame | None, key: str = "id") -> DataFrame:
    """Rows of a session; all of them if it lists none."""
    return rows if ids is None else rows.join(ids.select(key), key, "left_semi")


def with_content(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with the bytes of their originals, found by path: each once, however often the path is scanned."""
    return rows.join(files.groupBy("path").agg(F.max_by("content", F.struct("modified", "size")).alias("content")), "path", "left")


def decoded(rows: DataFrame, decode, schema: str) -> DataFrame:
    """Rows with what a caller's decoder makes of their bytes. decode(bytes) gives a tuple of ``schema``; what it raises goes to err.

    No decoder of compressed images is at hand here, so this is where one is put in. One row is decoded at a time.
    """
    from collections.abc import Iterator

    import pandas as pd

    fields = [c.split()[0] for c in schema.split(", ")]
    kept = [c for c in rows.columns if c not in ("content", "err")]
    out = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + f", {schema}, err string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for content in b.content:
                try:
                    got.append((*decode(None if content is None else bytes(content)), None))
                except Exception as e:  # one bad row must not end the job
                    got.append((*[None] * len(fields), str(e)[:200] or type(e).__name__))
            yield pd.concat([b[kept].reset_index(drop=True), pd.DataFrame(got, columns=[*fields, "err"], dtype=object)], axis=1)

    return rows.mapInPandas(run, out)


def reconnect(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records with the file at their path; of two files at one path, the last modified."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.col("modified").desc_nulls_last(), F.col("size").desc_nulls_last()))
    return records.join(files.withColumn("_n", last).where("_n = 1").select("path", F.col("size").alias("file_size"), F.col("modified").alias("file_modified")), "path", "left")


def latest_resumable(sessions: DataFrame) -> DataFrame:
    """The newest session, if it is unfinished and past ingest: an older one never stands in for it."""
    return sessions.orderBy(F.col("created_at").desc(), F.col("session_id")).limit(1).where("stage NOT IN ('finished', 'ingest')")


def with_cache(found: DataFrame, cache: DataFrame, compute, key: str = "id") -> DataFrame:
    """Rows from the cache where their identity is there, and computed where it is not."""
    fresh = compute(found.join(cache.select(key), key, "left_anti"))
    return cache.join(found.select(key), key, "left_semi").unionByName(fresh, allowMissingColumns=True)


def live(rows: DataFrame) -> DataFrame:
    """Rows that were read without an error."""
    return rows.where("err IS NULL")
