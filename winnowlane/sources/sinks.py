"""Files put out: guarded CSV, JSON, folders of copies, archives."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnowlane.functions.text import csv_field, csv_number

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One text column ``line`` of RFC 4180 fields; text that a spreadsheet would run is guarded. No header."""
    fields = [csv_number(F.col(c)) if isinstance(rows.schema[c].dataType, NUMBERS) else csv_field(F.col(c).cast("string")) for c in columns]
    return rows.select(*[c for c in ("ord",) if c in rows.columns], F.concat_ws(",", *fields).alias("line"))


def write_csv(rows: DataFrame, columns: list[str], path: str, bom: bool = False) -> None:
    """Part files with CRLF line ends, each with a header."""
    head = ("﻿" if bom else "") + ",".join(columns)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        for b in batches:
            yield pd.DataFrame({"value": b.line})

    csv_lines(rows, columns).select("line").mapInPandas(lines, "value string").write.option("lineSep", "\r\n").text(path)


def csv_text(rows: DataFrame, columns: list[str], bom: bool = False) -> str:
    """The same as one text, for tables small enough to show; rows in the order of ``ord`` if they have it."""
    out = csv_lines(rows, columns)
    out = out.orderBy("ord") if "ord" in out.columns else out
    return ("﻿" if bom else "") + "".join(f"{x}\r\n" for x in [",".join(columns), *(r.line for r in out.toLocalIterator())])


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_manifest(rows: DataFrame, columns: list[str], path: str) -> tuple[str, str]:
    """A manifest twice under one folder: CSV with a byte order mark in each part file, and JSON lines of the same columns."""
    out = f"{path.rstrip('/')}/csv", f"{path.rstrip('/')}/json"
    write_csv(rows, columns, out[0], bom=True)
    write_json(rows.select(*columns), out[1])
    return out


def write_folders(rows: DataFrame, path: str, by: str = "folder", mode: str = "append") -> str:
    """Rows by folder. Modes: append to what is there, overwrite it, or sibling: a new folder with the time in its name."""
    if mode == "sibling":
        from datetime import datetime, timezone

        path, mode = f"{path.rstrip('/')}-{datetime.now(timezone.utc):%Y%m%d-%H%M%S}", "errorifexists"
    rows.write.mode(mode).partitionBy(by).parquet(path)
    return path


def copy_plan(rows: DataFrame, there: DataFrame) -> DataFrame:
    """folder, name, size and out_name of files still to be copied, never over another.

    A file of the same name and size in the folder is taken as copied before. Another of that name gets the
    next free suffix. ``there``: folder, name and size of what the target holds.
    """
    from winnowlane.operators.results import unique_names

    low = lambda f: f.withColumn("_low", F.lower("name"))
    todo = low(rows).join(low(there).select("folder", "_low", "size"), ["folder", "_low", "size"], "left_anti").drop("_low")
    order = Window.partitionBy("folder").orderBy("ord")
    marked = todo.withColumn("ord", F.row_number().over(order).cast("long")).withColumn("_there", F.lit(False))
    held = there.select("folder", "name", "size", F.lit(0).cast("long").alias("ord"), F.lit(True).alias("_there"))
    return unique_names(held.unionByName(marked, allowMissingColumns=True)).where("NOT _there").drop("_there")


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write each row's content to root/folder/out_name; folder, out_name, size and err of every row: one that fails harms no other.

    Files are written under another name and renamed, so a task that is run again finds whole files or none, and a
    file that is there with its size is not written again. The root is a folder that all executors share.
    """
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            out = []
            for folder, name, content in zip(b.folder, b.out_name, b.content):
                try:
                    if content is None:
                        raise ValueError("unreadable")
                    place = "/".join(x for x in (base, folder or "", name) if x)
                    if (seen := system.get_file_info(place)).type == fs.FileType.NotFound or seen.size != len(content):
                        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        draft = f"{place}.{uuid.uuid4().hex}"
                        with system.open_output_stream(draft) as stream:
                            stream.write(bytes(content))
                        system.move(draft, place)
                    out.append((folder, name, len(content), None))
                except Exception as e:  # one bad row must not end the job
                    out.append((folder, name, None, str(e)[:200] or type(e).__name__))
            yield pd.DataFrame(out, columns=["folder", "out_name", "size", "err"]).astype({"size": "Int64"})

    return rows.select("folder", "out_name", "content").mapInPandas(run, "folder string, out_name string, size long, err string")


def stored_zip(files: Iterable[tuple[str, bytes | None]]) -> bytes:
    """An archive without compression; unreadable files (None) are left out, and one without files is refused."""
    out, n = io.BytesIO(), 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in files:
            if content is not None:
                z.writestr(zipfile.ZipInfo(name), content)
                n += 1
    if not n:
        raise ValueError("no file could be read")
    return out.getvalue()


def zip_rows(rows: DataFrame) -> bytes:
    """An archive of rows (name, content), fetched partition by partition: for a hand-picked set."""
    return stored_zip((r.name, None if r.content is None else bytes(r.content)) for r in rows.select("name", "content").toLocalIterator())


def name_list(rows: DataFrame) -> DataFrame:
    """Folder and file name of each row."""
    return rows.select(F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.col("name")).alias("file"))
