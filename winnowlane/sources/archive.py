"""An archive of any size, written by many tasks: entries get their offsets from running sums, and each task writes its stretch.

The stretches, in the order of their names, followed by the directory are one ZIP file without compression, with the 64-bit
records where numbers ask for them. No content passes through the driver, and only the directory, which
has a record for each entry, is one task's work.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowlane.operators.order import running
from winnowlane.scratch import materialize, parts

#: Bytes of a stretch; one entry may be larger.
STRETCH = 256 << 20
#: The largest numbers of the 32-bit and 16-bit fields, the flag of names in UTF-8, and the date of entries without one.
MOST_32, MOST_16, UTF8, NO_DATE = 0xFFFFFFFF, 0xFFFF, 0x800, 0x21
HEADER, DIRECTORY = "<4sHHHHHIIIHH", "<4sHHHHHHIIIHHHHHII"
LAST = "directory"


def write_archive(rows: DataFrame, root: str, stretch: int = STRETCH, most: int = MOST_32, most_entries: int = MOST_16) -> DataFrame:
    """Write rows (name, content) under root, a folder that all executors share; name, size, crc and offset of each entry.

    Entries come in the order of their names; rows that repeat a name are entries of their own. Rows without content or name
    are left out; without any entry the directory alone is a valid empty archive. Files are written under another
    name and renamed, so a task that is run again leaves one.
    """
    from pyarrow import fs

    head = struct.calcsize(HEADER)
    entries = rows.where("name IS NOT NULL AND content IS NOT NULL").select("name", "content", F.sha2("content", 256).alias("_print"), F.monotonically_increasing_id().alias("_row"))
    entries = entries.withColumn("bytes", (F.lit(head) + F.octet_length("name") + F.octet_length("content")).cast("long"))
    placed = running(entries, [], [F.col("name"), F.col("_print"), F.col("_row")], "bytes").withColumn("offset", F.col("upto") - F.col("bytes"))
    placed = placed.select("name", "content", "offset", F.floor((F.col("upto") - F.col("bytes")) / stretch).alias("stretch"))
    dealt = placed.repartition(parts(rows.sparkSession), "stretch").sortWithinPartitions("stretch", "offset")

    def place(name: str):
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        return system, f"{base}/{name}.{uuid.uuid4().hex}", f"{base}/{name}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream, done = None, None, None

        def close() -> None:
            if stream is not None:
                stream.close()
                done[0].move(done[1], done[2])

        for batch in batches:
            out = []
            for name, content, offset, number in zip(*(batch.column(c) for c in ("name", "content", "offset", "stretch"))):
                if number.as_py() != now:
                    close()
                    now = number.as_py()
                    done = place(f"{now:012d}")
                    stream = done[0].open_output_stream(done[1])
                data, label = content.as_buffer(), name.as_py().encode()
                crc = zlib.crc32(data)
                stream.write(struct.pack(HEADER, b"PK\x03\x04", 20, UTF8, 0, 0, NO_DATE, crc, len(data), len(data), len(label), 0) + label)
                stream.write(data)
                out.append((name.as_py(), len(data), crc, offset.as_py()))
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "size", "crc", "offset"), x)) for x in out], schema=kinds)
        close()

    kinds = pa.schema([("name", pa.string()), ("size", pa.int64()), ("crc", pa.int64()), ("offset", pa.int64())])
    written = materialize(dealt.mapInArrow(write, "name string, size long, crc long, offset long"), "entries")

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, draft, final = place(LAST)
        n = size = begin = 0
        with system.open_output_stream(draft) as stream:
            for batch in batches:
                for name, length, crc, offset in zip(*(batch.column(c).to_pylist() for c in ("name", "size", "crc", "offset"))):
                    if name is None:  # the row that is always there
                        continue
                    label = name.encode()
                    extra = struct.pack("<HHQ", 1, 8, offset) if offset >= most else b""
                    record = struct.pack(DIRECTORY, b"PK\x01\x02", 45, 45 if extra else 20, UTF8, 0, 0, NO_DATE, crc, length, length, len(label), len(extra), 0, 0, 0, 0, MOST_32 if extra else offset)
                    stream.write(record + label + extra)
                    n, size, begin = n + 1, size + len(record) + len(label) + len(extra), offset + head + len(label) + length
            if n >= most_entries or begin >= most or size >= most:
                stream.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, begin) + struct.pack("<4sIQI", b"PK\x06\x07", 0, begin + size, 1))
                stream.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, MOST_16, MOST_16, MOST_32, MOST_32, 0))
            else:
                stream.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, size, begin, 0))
        system.move(draft, final)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    none = rows.sparkSession.range(1).select(*[F.lit(None).cast(k).alias(c) for c, k in written.dtypes])
    materialize(written.unionByName(none).repartition(1).sortWithinPartitions("offset").mapInArrow(directory, "n long"), "directory")
    return written


def read_archive(spark, root: str) -> DataFrame:
    """name and content of every entry of an archive of stretches, a stretch to a row of a task; one that is damaged is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(root).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in batch.column("content"):
                data, at = memoryview(whole.as_buffer()), 0
                while at < len(data):
                    mark, *_, crc, size, _, named, more = struct.unpack_from(HEADER, data, at)
                    at += struct.calcsize(HEADER)
                    name, body = bytes(data[at : at + named]).decode(), data[at + named + more : at + named + more + size]
                    if mark != b"PK\x03\x04" or len(body) != size or zlib.crc32(body) != crc:
                        raise ValueError(f"the archive is damaged at {name}")
                    yield pa.RecordBatch.from_pydict({"name": [name], "content": pa.array([bytes(body)], pa.binary())})
                    at += named + more + size

    return files.mapInArrow(run, "name string, content binary")
