import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnowlane.functions import capture, signature, text
from winnowlane.operators import geo, organize, results, similarity, stats, tags
from winnowlane.sources import files, metadata, sinks

# The published distances of a chain of eight.
CHAIN = """0 14 24 34 36 32 32 32
14 0 10 24 30 28 32 34
24 10 0 16 28 30 30 28
34 24 16 0 16 26 32 32
36 30 28 16 0 10 22 26
32 28 30 26 10 0 12 20
32 32 30 32 22 12 0 8
32 34 28 32 26 20 8 0"""


def test_chain_of_eight():
    d = np.array([list(map(int, r.split())) for r in CHAIN.splitlines()])
    assert similarity.union_labels(d <= 14).tolist() == [0, 0, 0, 3, 4, 4, 4, 4]
    assert similarity.strict_labels(d, 14).tolist() == [0, 0, 1, 2, 3, 3, 4, 4]


def test_corrections():
    label = np.array([0, 0, 0, 3])
    assert similarity.correct(label, {(0, 1)}, []).tolist() == [0, 1, 0, 2]
    assert len(set(similarity.correct(label, set(), [(2, 3)]).tolist())) == 1


def test_gap_events(spark):
    at = lambda d, h, m: dt.datetime(2024, 5, d, h, m)
    s = spark.createDataFrame([(1, at(1, 9, 0)), (2, at(1, 9, 40)), (3, at(1, 13, 0)), (4, at(2, 0, 30)), (5, None)], "id long, ts timestamp_ntz")
    for gap, want in ((2, 3), (0.5, 4)):
        e = organize.gap_events(s, "ts", "id", gap)
        assert e.agg(F.max("event_no")).head()[0] == want
        assert e.where("id = 5").head().event_no is None


def test_places(spark):
    s = spark.createDataFrame([("u", 1, 35.0116, 135.7681), ("u", 2, 35.0296, 135.7681), ("u", 3, 34.6937, 135.5023), ("u", 4, None, None)], "unit string, id long, lat double, lon double").withColumn("ts", F.col("id"))
    for km, want in ((5.0, 2), (1.0, 3)):
        assert geo.locations(s, km, "unit").select("cluster").distinct().count() == want


def test_banded_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    hi = rng.integers(0, 2**32, 60)
    rows = [(i, "u", int(h ^ (1 << int(rng.integers(32)))), int(l)) for i, (h, l) in enumerate(zip(np.repeat(hi[:20], 3), np.repeat(hi[20:40], 3)))]
    s = spark.createDataFrame(rows, "id long, unit string, hi long, lo long")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and bin(a[2] ^ b[2]).count("1") + bin(a[3] ^ b[3]).count("1") <= 4}
    assert {(r.a, r.b) for r in similarity.close_pairs(s, 4).collect()} == want and want


def test_text(spark):
    names = ["CON", "a/b:c", "...x. ", "", None, "  two   words "]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(text.path_segment(F.col("s"))).collect()]
    assert got == ["CON_", "a-b-c", "x", "_", "_", "two words"]
    f = spark.createDataFrame([("=1+1",), ('a,"b"',), ("plain",), (None,)], "s string").select(text.csv_field(F.col("s")).alias("x"))
    assert [r.x for r in f.collect()] == ["'=1+1", '"a,""b"""', "plain", ""]
    n = spark.createDataFrame([("img10",), ("img2",), ("Img1",)], "s string").orderBy(text.natural_key(F.col("s")))
    assert [r.s for r in n.collect()] == ["Img1", "img2", "img10"]
    t = spark.createDataFrame([("2024:02:30 10:00:00",), ("2024:02:03 10:00:61",), ("2024:02:03 10:00:05",)], "s string").select(capture.iso_time(F.col("s")).alias("i"))
    assert [r.i for r in t.collect()] == ["2024-02-30T10:00:00", None, "2024-02-03T10:00:05"]
    c = spark.createDataFrame([("Canon", "Canon EOS R5"), ("NIKON CORP", "Z6"), (None, "X")], "a string, b string").select(capture.camera_label(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in c.collect()] == ["Canon EOS R5", "NIKON CORP Z6", "X"]


def test_hashes(spark):
    y, x = np.mgrid[0:64, 0:96]
    g = 255.0 * np.abs(np.sin(x / 9.0)) * np.abs(np.cos(y / 7.0))
    p = signature.frequency_hash(g)
    assert bin(int(p, 16)).count("1") == 31 and int(p, 16) >> 63 == 0
    assert signature.frequency_hash(g * 0.5 + 10) == p and signature.sharpness(g) > 0 and signature.sharpness(g[:2]) == 0
    assert signature.gradient_hash(np.tile(np.arange(90.0)[::-1], (8, 1))) == "f" * 16
    f = spark.createDataFrame([("a",), ("",)], "s string").select(signature.fnv1a32(F.col("s")).alias("h")).collect()
    assert f[1].h == 2166136261 and f[0].h == ((2166136261 ^ 97) * 16777619) % 2**32
    h = spark.createDataFrame([("0123456789abcdef",)], "x string").select(signature.halves(F.col("x")).alias("h")).select(signature.to_hex(F.col("h.hi"), F.col("h.lo")).alias("x"))
    assert h.head().x == "0123456789abcdef"


def tiff():
    import struct

    entries = [(0x0110, 2, b"X100\0"), (0x0112, 3, struct.pack("<H", 6)), (0x0132, 2, b"2024:05:01 09:00:00\0")]
    head, body = b"II*\0\x08\0\0\0" + struct.pack("<H", len(entries)), b""
    at = 8 + 2 + 12 * len(entries) + 4
    for tag, kind, raw in entries:
        count = len(raw) if kind == 2 else 1
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, count, at + len(body))
            body += raw
    return head + b"\0\0\0\0" + body


def test_metadata_and_damage():
    exif = b"Exif\0\0" + tiff()
    xmp = b'http://ns.adobe.com/xap/1.0/\0<x photoshop:City="Ky&#244;to"/>'
    jpeg = b"\xff\xd8" + b"".join(b"\xff\xe1" + (len(b) + 2).to_bytes(2, "big") + b for b in (exif, xmp)) + b"\xff\xd9"
    got = metadata.read(jpeg)
    assert (got["model"], got["orientation"], got["taken"], got["city"]) == ("X100", 6, "2024-05-01T09:00:00", "Kyôto")
    webp = b"RIFF\0\0\0\0WEBPEXIF" + len(exif).to_bytes(4, "little") + exif
    png = b"\x89PNG\r\n\x1a\n" + len(tiff()).to_bytes(4, "big") + b"eXIf" + tiff() + b"\0\0\0\0"
    assert metadata.read(webp)["model"] == metadata.read(png)["model"] == "X100"
    rng = np.random.default_rng(5)
    for cut in range(0, len(jpeg), 7):
        metadata.read(jpeg[:cut])
    for _ in range(300):
        bad = bytearray(jpeg)
        for i in rng.integers(0, len(bad), 6):
            bad[i] = rng.integers(256)
        metadata.read(bytes(bad))
    assert metadata.read(None)["err"] == metadata.read(b"text")["err"] == "unsupported"


def test_sets_and_names(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, ord long")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id long, ord long")
    assert {(r.id, r.set_no) for r in results.union_first([a, b]).collect()} == {(1, 0), (2, 0), (3, 1)}
    assert [r.ord for r in results.append(a, b).orderBy("ord").collect()] == [0, 1, 2, 3]
    n = spark.createDataFrame([("f", x, i) for i, x in enumerate(["a.jpg", "A.jpg", "a_2.jpg", "a.jpg"])], "folder string, name string, ord long")
    out = [r.out_name.lower() for r in results.unique_names(n).collect()]
    assert len(set(out)) == 4
    there = spark.createDataFrame([("f", "a.jpg", 5)], "folder string, name string, size long")
    plan = sinks.copy_plan(n.withColumn("size", F.when(F.col("ord") == 0, 5).otherwise(7).cast("long")), there)
    assert {r.out_name.lower() for r in plan.collect()}.isdisjoint({"a.jpg"}) and plan.count() == 3
    assert sinks.stored_zip([("x", b"1"), ("y", None)])[:2] == b"PK"
    with pytest.raises(ValueError):
        sinks.stored_zip([("y", None)])


def test_tags(spark):
    names = spark.createDataFrame([("t1", "Best", 1)], "tag_id string, name string, ord int")
    names = tags.add(names, spark.createDataFrame([("t2", " best ", 2), ("t3", "Print", 3), ("t4", " ", 4)], "tag_id string, name string, ord int"))
    assert [r.name for r in names.orderBy("ord").collect()] == ["Best", "Print"]
    assert {r.name for r in tags.rename(names, "t3", "BEST").collect()} == {"Best", "Print"}
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    marks = tags.put(spark.createDataFrame([(1, "t1")], "id long, tag_id string"), rows, "t3")
    assert {r.tag_id: r.coverage for r in tags.coverage(names, marks, rows).collect()} == {"t1": "some", "t3": "all"}
    assert tags.toggle(marks, rows, "t3").where("tag_id = 't3'").count() == 0


def test_nearest_ranks_and_sources(spark, tmp_path):
    s = spark.createDataFrame([("g", float(v)) for v in [5, 1, 1, 9, 7]], "g string, v double")
    r = stats.nearest_ranks(s, ["g"], "v").head()
    assert (r.n, r.min, r.p25, r.median, r.p75, r.max, r["mean"]) == (5, 1, 1, 5, 7, 9, 4.6)
    (tmp_path / "a" / ".hid").mkdir(parents=True)
    (tmp_path / "_tagged").mkdir()
    for p in ("a/x.JPG", "a/.hid/y.jpg", "_tagged/z.jpg", "b.txt"):
        (tmp_path / p).write_bytes(b"\xff\xd8\xff\xd9")
    got = {x.path: (x.kind, x["class"], x.f) for x in files.triage(files.scan(spark, str(tmp_path))).withColumn("f", files.sniff(F.col("content"))).collect()}
    assert got == {"a/x.JPG": ("jpeg", "image", "jpeg"), "b.txt": ("unknown", "unknown", "jpeg")}


def test_store(spark, tmp_path):
    from winnowlane.sources.store import Store

    st = Store(spark, f"file://{tmp_path}/s")
    assert st.all("t") is None
    v1 = st.put("t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"))
    st.put("t", spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"))
    assert {(r.id, r.x) for r in st.all("t").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    st.delete("t", st.get("t", 1))
    assert st.keys("t").count() == 2
    st.restore("t", v1)
    assert st.all("t").count() == 2


def test_live_sessions_and_ranking(spark, tmp_path):
    from winnowlane.operators.ranking import judge
    from winnowlane.streaming.live import live_ranking, live_sessions

    (tmp_path / "e").mkdir()
    at = lambda h, m: dt.datetime(2024, 5, 1, h, m)
    spark.createDataFrame([("u", at(9, 0)), ("u", at(9, 30)), ("u", at(14, 0)), ("u", at(23, 0))], "unit string, ts timestamp").write.mode("append").parquet(str(tmp_path / "e"))
    src = spark.readStream.schema("unit string, ts timestamp").parquet(str(tmp_path / "e"))
    q = live_sessions(src, "ts", ["unit"], 2).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("live").collect()) == [1, 2]
    _, log = judge(["a", "b", "c"], 1, 4, min)
    spark.createDataFrame([("u", i, o["t"], o["m"], o["w"]) for i, o in enumerate(log)], "unit string, seq long, type string, mid string, winner string").write.parquet(str(tmp_path / "o"))
    ops = spark.readStream.schema("unit string, seq long, type string, mid string, winner string").parquet(str(tmp_path / "o"))
    q = live_ranking(ops, {"u": ["a", "b", "c"]}, 1, 4).writeStream.format("memory").queryName("rank").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rank").head().places == ["a"]
