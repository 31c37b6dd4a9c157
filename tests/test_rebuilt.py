"""Edges of the operators, both sides of every size switch, and the queries of further operators against their SQL."""

import datetime as dt
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnowlane.functions import capture, signature, text
from winnowlane.operators import geo, order, organize, ranking, results, similarity, staged, stats
from winnowlane.sources import files, fixtures, metadata, sinks

D = "/root/testdata/sf0.001"
#: One or two queries of each group; the others run against their SQL on the larger tables.
SOME = ["capture_labels", "info_lines", "category_summary_all", "organize_levels", "text_scalars", "number_texts", "iso_times", "composed_turns", "shown_labels", "scanned_files", "capture_roundtrip", "reconnected_files", "store_versions", "manifest_files", "finalists_list", "folder_writes", "copy_suffixes", "copied_files", "set_folders", "numbered_folders", "eligible_rows", "pending_units", "tag_edits", "place_names", "pass_counters", "finished_passes", "rescue_limits", "quota_ladder", "toggled_rows", "schedule_totals", "replayed_rankings", "ranking_depths", "runoff_winners", "final_units", "shortest_percents", "applied_shares", "checksums", "image_hashes", "clamped_thresholds", "reviewed_groups", "correction_edits", "runoff_groups", "pair_truths", "strict_clusters", "corrected_clusters", "location_clusters", "seeded_deal", "alloc_apportion", "stream_counts", "stream_rankings"]


def plain(frame):
    out = frame[sorted(frame.columns)].astype(object)
    out = out.where(out.notna(), None)
    number = lambda x: float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else bool(x) if isinstance(x, np.bool_) else x
    return sorted(repr([number(x) for x in r]) for r in out.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    db = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = e.queries()[name](spark, D).toPandas(), db.sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_core_query_has_sql():
    from winnowlane import queries

    assert set(queries.queries()) == set(queries.oracle_sql())


def signatures(spark, n=90, units=3):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**32, (units, 2))
    rows = []
    for i in range(n):
        u = i % units
        flip = [1 << int(b) for b in rng.integers(0, 32, rng.integers(0, 9))]
        rows.append((i, f"u{u}", int(base[u][0]) ^ int(np.bitwise_xor.reduce(flip) if flip else 0), int(base[u][1]) ^ (1 << int(rng.integers(32)))))
    return spark.createDataFrame(rows, "id long, unit string, hi long, lo long"), rows


def test_pairs_of_blocks_and_bands(spark):
    s, rows = signatures(spark)
    for t in (4, 12):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and bin(a[2] ^ b[2]).count("1") + bin(a[3] ^ b[3]).count("1") <= t}
        for block in (2048, 7):
            got = [(r.a, r.b) for r in similarity.close_pairs(s, t, block=block).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    n = {(r.distance, r.pos + r.neg) for r in similarity.distance_counts(s, lambda a, b: (a + b) % 2 == 0, block=7).collect()}
    assert n == {(r.distance, r.pos + r.neg) for r in similarity.distance_counts(s).collect()}
    assert similarity.close_pairs(s.limit(0), 20).count() == 0


def test_clusters_on_both_sides_of_their_switches(spark):
    s, _ = signatures(spark)
    near = similarity.close_pairs(s, 12)
    whole = {(r.unit, r.id): r.group_id for r in similarity.union_clusters(near, s).collect()}
    assert {(r.unit, r.id): r.group_id for r in similarity.union_clusters(near, s, unit_pairs=0).collect()} == whole and len(whole) == 90
    links = spark.createDataFrame([(0, 3, -1), (0, 89, 1), (1, 88, 1), (4, 7, -1)], "a long, b long, sign int")
    for mode in ("strict", "union"):
        for t in (4, 10):
            one = {(r.unit, r.id): r.group_id for r in similarity.cluster(s, t, mode, links).collect()}
            assert {(r.unit, r.id): r.group_id for r in similarity.cluster(s, t, mode, links, unit_rows=1).collect()} == one and len(one) == 90
    assert similarity.cluster(s.limit(0), 10).count() == 0


def test_positions_and_running_sums_of_hot_units(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"c{i % 7}", i % 50, i, float(i % 11)) for i in range(600)]
    f = spark.createDataFrame(rows, "unit string, score long, id long, v double")
    want = {}
    for u in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == u), key=lambda r: (-r[1], r[2]))):
            want[r[2]] = (k, sum(x[0] == u for x in rows))
    assert {r.id: (r.pos, r._n) for r in order.positions(f, "unit", [F.col("score").desc(), F.col("id")]).collect()} == want
    all_ = {r.id: r.pos for r in order.positions(f, None, [F.col("score"), F.col("id")]).collect()}
    assert all_ == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    med = {r.unit: r.median for r in stats.medians(f, ["unit"], "v").collect()}
    assert med == {u: float(np.median([r[3] for r in rows if r[0] == u])) for u in {r[0] for r in rows} if u is not None} | {None: med[None]}
    assert order.positions(f.limit(0), "unit", [F.col("id")]).count() == 0


def test_gap_events_of_one_stream(spark):
    rng = np.random.default_rng(3)
    at = np.cumsum(rng.integers(1, 90, 400))
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)), 0) for i, m in enumerate(at)] + [(900, None, 0), (901, rng and dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(at[5])), 0)]
    s = spark.createDataFrame(rows, "id long, ts timestamp_ntz, one int").repartition(5)
    a = {r.id: (r.event_no, r.event_label) for r in organize.gap_events(s, "ts", "id", 1.0).collect()}
    b = {r.id: (r.event_no, r.event_label) for r in organize.gap_events(s, "ts", "id", 1.0, ["one"]).collect()}
    assert a == b and a[900] == (None, None) and len({v for v in a.values()}) > 20


def test_edges_of_text_and_capture(spark):
    names = ["IMG1626253953123", "IMG1626253953129", "IMG16262539531230", "img2", "img10", "img002x", "9", "10"]
    keys = {r.s: r.k for r in spark.createDataFrame([(n,) for n in names], "s string").select("s", text.natural_key(F.col("s")).alias("k")).collect()}
    assert sorted(names, key=keys.get) == ["9", "10", "img2", "img002x", "img10", "IMG1626253953123", "IMG1626253953129", "IMG16262539531230"] and len(set(keys.values())) == len(names)
    times = ["1904:01:01 00:00:00", "1970:01:01 00:00:00", "2200:12:31 23:59:59", "2201:01:01 00:00:00", "2024:13:01 00:00:00"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "s string").select(capture.iso_time(F.col("s"))).collect()]
    assert got == [None, "1970-01-01T00:00:00", "2200-12-31T23:59:59", None, None] and [metadata.iso_time(t) for t in times] == got
    sides = spark.createDataFrame([(5101, 5000, 0), (5100, 5000, 0), (5101, 5000, 1), (0, 5, 0)], "w int, h int, r int").select(capture.orientation(F.col("w"), F.col("h"), F.col("r")).alias("o"))
    assert [r.o for r in sides.collect()] == ["Landscape", "Square", "Portrait", None]
    assert organize.keeps_folders(None) and organize.keeps_folders(["folder"]) and not organize.keeps_folders([])
    assert organize.normal_spec({"gap_hours": -1, "categories": ["day", "x", "day"]}) == {"categories": ["day"], "gap_hours": 2.0, "radius_km": 5.0, "names": {}}


def test_nearest_places_over_the_date_line_and_the_pole(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)))] + [(900, 10.0, 179.9), (901, 89.9, 0.0), (902, -89.95, 120.0)]
    places = [("line", 10.0, -179.9), ("pole", 89.9, 180.0), ("south", -89.9, -60.0), *[(f"p{k}", float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(-85, 85, 25), rng.uniform(-180, 180, 25)))]]
    p, q = spark.createDataFrame(pts, "id long, lat double, lon double"), spark.createDataFrame(places, "name string, lat double, lon double")
    for km in (50.0, 1500.0, 6000.0):
        want = {}
        for i, a, o in pts:
            d = geo._km(a, o, np.array([x[1] for x in places]), np.array([x[2] for x in places]))
            if d.min() <= km:
                want[i] = min((round(v, 9), n[0]) for v, n in zip(d, places))[1]
        assert {r.id: r.name for r in geo.nearest_within(p, q, km, ["id"]).collect()} == want


def test_faces_of_rows_without_a_group(spark):
    pool = spark.createDataFrame([("u", i, 100 - i) for i in range(40)], "unit string, id long, ord long")
    groups = spark.createDataFrame([("u", i, None if i > 5 else "g") for i in range(40)], "unit string, id long, group_id string")
    out = {r.id: (r.face, r.pos) for r in staged.faces(pool, groups, spark.createDataFrame([(2,)], "id long")).collect()}
    assert out[0] == out[5] == (2, 95) and all(out[i] == (i, 100 - i) for i in range(6, 40))


def test_image_hashes_and_files(spark, tmp_path):
    rng = np.random.default_rng(9)
    g = rng.uniform(0, 255, (40, 60))
    h, w = g.shape
    small = np.zeros((8, 9))
    for y in range(8):
        for x in range(9):
            fx, fy = (x + 0.5) * w / 9 - 0.5, (y + 0.5) * h / 8 - 0.5
            x0, y0 = int(np.floor(fx)), int(np.floor(fy))
            c = lambda v, n: min(max(v, 0), n - 1)
            a, b, e, d = g[c(y0, h), c(x0, w)], g[c(y0, h), c(x0 + 1, w)], g[c(y0 + 1, h), c(x0, w)], g[c(y0 + 1, h), c(x0 + 1, w)]
            tx, ty = fx - x0, fy - y0
            small[y, x] = a * (1 - tx) * (1 - ty) + b * tx * (1 - ty) + e * (1 - tx) * ty + d * tx * ty
    bits = "".join("1" if small[y, x] < small[y, x + 1] else "0" for y in range(8) for x in range(8))
    assert signature.ingest_hash(g) == f"{int(bits, 2):016x}"
    assert signature.fitted(4000, 3000, 1600) == (1600, 1200) and signature.fitted(30, 20, 320) == (30, 20)
    assert (signature.turned(np.array([[1, 2], [3, 4]]), 1, False) == [[3, 1], [4, 2]]).all() and (signature.turned(np.array([[1, 2]]), 0, True) == [[2, 1]]).all()
    lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
    assert abs(signature.raw_sharpness(g) - lap.var()) < 0.01 and signature.raw_sharpness(g[:2]) == 0
    f = spark.createDataFrame([("a", b"\x07"), ("b", None)], "path string, content binary")
    out = {r.path: (r.v, r.err is None) for r in files.decoded(f, lambda c: (int(c[0]),), "v long").collect()}
    assert out["a"] == (7, True) and out["b"] == (None, False)
    rows = spark.createDataFrame([("x", "one", b"12"), ("x", "one/", b"3"), (None, "two", b"")], "folder string, out_name string, content binary")
    got = {r.out_name: r.size for r in sinks.write_files(rows, f"file://{tmp_path}/o").collect()}
    assert got["one"] == 2 and got["two"] == 0 and (tmp_path / "o" / "x" / "one").read_bytes() == b"12"


def test_damaged_metadata_never_raises():
    rng = np.random.default_rng(5)
    record = {"id": 4, "taken": "2024-05-01T09:00:00", "tz": "+09:00", "make": "M", "model": "X", "lens": "L", "fl35": 35.0, "fl": 20.0, "f": 2.8, "exposure": 0.01, "iso": 200.0, "lat": 1.5, "lon": -2.5, "city": "Kyôto", "sublocation": None, "state": "S", "country": "J"}
    for k in range(5):
        whole = fixtures.image(record | {"id": 20 + k})
        assert metadata.read(whole)["model"] == "X" and metadata.read(whole)["city"] == "Kyôto"
        for cut in range(0, len(whole), 7):
            metadata.read(whole[:cut])
        for _ in range(60):
            bad = bytearray(whole)
            for i in rng.integers(0, len(bad), 6):
                bad[i] = rng.integers(256)
            metadata.read(bytes(bad))


def test_store_survives_a_crash(spark, tmp_path):
    from winnowlane.sources.store import Store

    st = Store(spark, f"file://{tmp_path}/s")
    st.put("t", spark.createDataFrame([(1, "a")], "id long, x string"))
    # a crash after a version was written, while its pointer was: the version before holds
    (tmp_path / "s" / "t" / "current" / ".draft").write_bytes(b"\0")
    assert [r.x for r in Store(spark, f"file://{tmp_path}/s").all("t").collect()] == ["a"]
    st.clear("t")
    assert st.all("t") is None


def test_no_machine_local_folder_on_a_cluster():
    from winnowlane import scratch

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_decisions_refuse_long_sections(spark, monkeypatch):
    monkeypatch.setattr(results, "SECTION_ROWS", 3)
    with pytest.raises(ValueError):
        results.decisions(spark, {"x": spark.range(4)})
    assert '"x":[{"id":0}' in results.decisions(spark, {"x": spark.range(1)}).head().json


def test_ranking_of_one_and_of_none(spark):
    f = spark.createDataFrame([("u", 1, 2.0)], "unit string, id long, score double")
    assert [(r.id, r.place) for r in ranking.rank_by_score(f, "unit", "id", "score", 3, 1).collect()] == [(1, 1)]
    assert ranking.final_unit(spark.createDataFrame([(1, 0)], "id long, ord long"), 5).count() == 0


def test_folds_over_units_in_batches(spark):
    rows = [(None if i % 5 == 0 else f"u{i % 7}", i, i * 10) for i in range(300)]
    f = spark.createDataFrame(rows, "unit string, id long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        out = order.fold_units(f, "unit", ["id"], lambda u, c: {"unit": [u], "first": [c["id"][0]], "n": [len(c["id"])]}, "unit string, first long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {u: (min(r[1] for r in rows if r[0] == u), sum(r[0] == u for r in rows)) for u in {r[0] for r in rows}}
    assert {r.unit: (r.first, r.n) for r in out} == want and len(out) == len(want)
    assert order.fold_units(f.limit(0), "unit", ["id"], lambda u, c: {"unit": [], "first": [], "n": []}, "unit string, first long, n long").count() == 0


def test_quotas_on_both_sides_of_their_switch(spark):
    from winnowlane.operators import hierarchy as h

    rows = spark.createDataFrame([(f"{d}/{i}", d) for d, n in {"T": 3, "T/A": 5, "T/B/C": 7, "": 2, "S": 4}.items() for i in range(n)], "id string, dir string")
    nodes, held = h.tree(rows)
    assert {(r.path, r.own_count, r.synthetic) for r in nodes.collect()} == {("", 0, False), ("__loose__", 2, True), ("T", 0, False), ("T/__loose__", 3, True), ("T/A", 5, False), ("T/B", 0, False), ("T/B/C", 7, False), ("S", 4, False)}
    assert {r.node: r["count"] for r in held.groupBy("node").count().collect()} == {"__loose__": 2, "T/__loose__": 3, "T/A": 5, "T/B/C": 7, "S": 4}
    quotas = spark.createDataFrame([("", "9"), ("T", "50%"), ("T/A", "2"), ("S", "0")], "path string, raw string")
    got = [sorted(map(str, h.resolve(nodes, quotas, few).collect())) for few in (200_000, 0)]
    assert got[0] == got[1] and len(got[0]) == 8


def test_subscribers_of_streams(spark, tmp_path):
    import time

    from winnowlane.streaming import live

    spark.range(7).write.parquet(str(tmp_path / "in"))
    watch, heard = live.Watch(), []
    watch.subscribe(lambda *a: 1 / 0)
    leave = watch.subscribe(lambda event, name, rows: heard.append((event, rows)))
    spark.streams.addListener(watch)
    try:
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").trigger(availableNow=True).queryName("q").start()
        q.awaitTermination()
        for _ in range(100):
            if any(e == "ended" for e, _ in heard):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    leave()
    assert sum(n for e, n in heard if e == "progress") == 7 and heard[0][0] == "started" and len(watch.subscribers) == 1
