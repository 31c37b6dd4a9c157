"""Archives written by many tasks, read by a program that knows nothing of them."""

import glob
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from winnowlane.scratch import fresh_path
from winnowlane.sources import archive


def whole(root):
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(root.removeprefix("file://") + "/*")))


@pytest.mark.parametrize("limits", [{}, {"stretch": 300}, {"stretch": 300, "most": 500, "most_entries": 3}])
def test_many_tasks_write_one_archive(spark, limits):
    rows = [(f"{i % 7}/näme {i}.txt", bytes([i % 256]) * (i * 7 % 400)) for i in range(120)] + [("twice", b"one"), ("twice", b"two"), ("empty", b""), ("none", None), (None, b"x")]
    root = fresh_path(spark, "archive")
    out = archive.write_archive(spark.createDataFrame(rows, "name string, content binary").repartition(5), root, **limits)
    with zipfile.ZipFile(io.BytesIO(whole(root))) as z:
        assert z.testzip() is None
        want = sorted((n, c) for n, c in rows if n is not None and c is not None)
        assert sorted((i.filename, z.read(i)) for i in z.infolist()) == want and [i.filename for i in z.infolist()] == sorted(n for n, _ in want)
        assert sorted((r.name, r.size, r.offset) for r in out.collect()) == sorted((i.filename, i.file_size, i.header_offset) for i in z.infolist())
    assert sorted((r.name, bytes(r.content)) for r in archive.read_archive(spark, root).collect()) == want
    assert len(glob.glob(root.removeprefix("file://") + "/*")) == (2 if "stretch" not in limits else len({r.offset // 300 for r in out.collect()}) + 1)


def test_an_archive_of_nothing(spark):
    root = fresh_path(spark, "archive")
    assert archive.write_archive(spark.createDataFrame([("a", None)], "name string, content binary"), root).count() == 0
    with zipfile.ZipFile(io.BytesIO(whole(root))) as z:
        assert z.namelist() == []


def test_a_damaged_archive_is_an_error(spark):
    root = fresh_path(spark, "archive")
    archive.write_archive(spark.range(5).select(F.col("id").cast("string").alias("name"), F.lit(b"abc").alias("content")), root)
    path = glob.glob(root.removeprefix("file://") + "/0*")[0]
    data = bytearray(open(path, "rb").read())
    data[-1] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        archive.read_archive(spark, root).collect()
