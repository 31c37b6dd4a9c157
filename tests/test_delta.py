"""Delta tables: batches count once, crashes leave the table before, small puts write little."""

import os

import pytest
from pyspark.sql import functions as F

from winnowlane.scratch import fresh_path
from winnowlane.sources.delta import DeltaTable


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0] is None, r))


def size(root):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(root.removeprefix("file://")) for f in files if f.endswith(".parquet"))


def test_batches_count_once(spark):
    t = DeltaTable(spark, fresh_path(spark, "delta"), buckets=4)
    make = lambda data: spark.createDataFrame(data, "id long, x string")
    assert t.read() is None and t.get(1) is None and t.last_batch("w") is None
    assert t.put(make([(1, "a"), (2, "b"), (None, "n")]), "w", 0) and not t.put(make([(1, "lost")]), "w", 0)
    assert t.put(make([(2, "c"), (3, "d"), (3, "d")]), "w", 1) and t.put(make([(2, "e")]), "v", 0)
    assert rows(t.read()) == [(1, "a"), (2, "e"), (3, "d"), (None, "n")]
    assert t.delete(make([(1, None), (None, None), (9, None)]), "v", 1)
    assert t.put(make([]), "w", 2) and t.last_batch("w") == 2
    want = [(2, "e"), (3, "d")]
    assert rows(t.read()) == want and rows(t.get(2)) == [(2, "e")] and rows(t.get(1)) == []
    before = t.read()
    t.compact()
    assert rows(t.read()) == want == rows(before) and len(t.log()) == 1
    again = DeltaTable(spark, t.root, buckets=99)  # the table's own number holds
    assert again.buckets == 4 and not again.put(make([(2, "stale")]), "w", 2) and not again.delete(make([(2, "")]), "v", 0)
    assert again.put(make([(1, "back"), (3, "f")]), "w", 3) and rows(again.read()) == [(1, "back"), (2, "e"), (3, "f")]
    more = spark.createDataFrame([(5, "g", 1.5)], "id long, x string, y double")
    assert again.put(more, "w", 4) and [(r.id, r.y) for r in again.read().orderBy("id").collect()] == [(1, None), (2, None), (3, None), (5, 1.5)]
    assert again.clean() == 5 and again.read().count() == 4 and again.clean() == 0
    with pytest.raises(ValueError):
        again.put(more.withColumn("_seq", F.lit(1)), "w", 5)


def test_a_crash_leaves_the_table_before(spark, monkeypatch):
    t = DeltaTable(spark, fresh_path(spark, "delta"), buckets=4)
    make = lambda x: spark.range(10).select("id", F.lit(x).alias("x"))
    t.put(make("old"), "w", 0)

    def crash(*_):
        raise OSError("lost")

    for when in ("_written", "_name"):
        with monkeypatch.context() as m:
            m.setattr(DeltaTable, when, crash)
            with pytest.raises(OSError):
                t.put(make("new"), "w", 1)
            with pytest.raises(OSError):
                t.delete(make("new"), "w", 1)
        assert {r.x for r in t.read().collect()} == {"old"} and t.last_batch("w") == 0
    # of two that write the same entry one is refused, and what it wrote is never seen
    log = t.log()
    with monkeypatch.context() as m:
        m.setattr(DeltaTable, "log", lambda self: log)
        t.put(make("first"), "w", 1)
        with pytest.raises(RuntimeError):
            t.put(make("second"), "v", 1)
    assert {r.x for r in t.read().collect()} == {"first"} and t.clean() == 3


def test_a_small_put_writes_little(spark):
    t = DeltaTable(spark, fresh_path(spark, "delta"), buckets=4)
    whole = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    t.put(whole, "w", 0)
    before = size(t.root)
    t.put(whole.where("id % 100 = 3").withColumn("x", F.upper("x")), "w", 1)
    assert size(t.root) - before < 0.03 * before
    plan = t.get(5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(_bucket") == 2 and t.get(103).first().x.isupper()
