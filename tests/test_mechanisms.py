"""Forests, pivots, sparse linkage and folds without rows, each against the plain way."""

import math
import random
import resource
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from winnowlane.operators import geo, order, ranking, similarity
from winnowlane.scratch import fresh_path


def signatures(rng, units, n, clusters, spread):
    rows = []
    for u in units:
        centres = [rng.getrandbits(64) for _ in range(clusters)] if clusters else None
        for i in range(n):
            x = rng.choice(centres) if centres else rng.getrandbits(64)
            for _ in range(rng.randint(0, spread)):
                x ^= 1 << rng.randrange(64)
            rows.append((u, f"{u}{i:05d}", x >> 32, x & 0xFFFFFFFF))
    return rows


KIND = "unit string, id string, hi long, lo long"


@pytest.fixture(scope="module")
def grouped(spark):
    rows = signatures(random.Random(1), ["a", "b"], 120, 10, 5)
    return spark.createDataFrame(rows + [("c", "c0", 1, 2)], KIND).cache()


def brute(rows, threshold):
    return sorted((x[0], *sorted((x[1], y[1])), d) for i, x in enumerate(rows) for y in rows[:i] if x[0] == y[0] and (d := ((x[2] ^ y[2]).bit_count() + (x[3] ^ y[3]).bit_count())) <= threshold)


def test_forest_gives_the_groups_of_every_threshold(grouped):
    pairs = similarity.close_pairs(grouped, 20)
    one, rounds = (similarity.spanning_forest(pairs, unit_pairs=n) for n in (5_000_000, 30))
    assert sorted(one.collect()) == sorted(rounds.collect())
    assert one.count() < grouped.count()
    for t in (0, 4, 10, 20):
        want = sorted(similarity.union_clusters(similarity.close_pairs(grouped, t), grouped).collect())
        assert sorted(similarity.groups_at(one, grouped, t).collect()) == want
    none = similarity.spanning_forest(pairs.limit(0))
    assert none.count() == 0 and similarity.groups_at(none, grouped, 20).where("id != group_id").count() == 0


@pytest.mark.parametrize("mode", ["strict", "union"])
def test_sparse_linkage_equals_dense(spark, grouped, mode):
    links = spark.createDataFrame([("a00001", "a00002", 1), ("a00003", "a00005", -1), ("b00003", "b00009", 1), ("a00001", "b00002", 1)], "a string, b string, sign int")
    for t in (6, 12):
        for said in (None, links):
            dense, sparse, both = (sorted(similarity.cluster(grouped, t, mode, said, unit_rows=n).collect()) for n in (4096, 0, 100))
            assert dense == sparse == both and len(dense) == grouped.count()


def test_sparse_linkage_of_long_chains_is_linear_in_pairs():
    n = 50_000
    a = np.concatenate([np.arange(n - k) for k in (1, 2, 3)])
    b = np.concatenate([np.arange(k, n) for k in (1, 2, 3)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    label = similarity.sparse_strict_labels(n, a, b, b - a)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB; all distances would take 5 GB
    assert (np.bincount(label) <= 4).all() and len(label) == n
    m = 300
    d = np.abs(np.arange(m)[:, None] - np.arange(m)[None, :])
    x, y = np.nonzero(np.triu(d <= 3, 1))
    assert similarity.sparse_strict_labels(m, x, y, d[x, y]).tolist() == similarity.strict_labels(d, 3).tolist()


def compared(cells):
    per = cells.groupBy("unit", "_cell").agg(F.sum(F.col("_home").cast("double")).alias("h"), F.sum((~F.col("_home")).cast("double")).alias("g"))
    return per.select(F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.col("g"))).first()[0]


@pytest.mark.parametrize("threshold", [10, 14, 20])
def test_pivots_lose_no_pair(spark, threshold):
    rng = random.Random(threshold)
    rows = signatures(rng, ["p"], 400, 40, 4) + signatures(rng, ["q"], 250, 0, 0) + signatures(rng, ["r"], 20, 2, 3) + [("p", "twin", *signatures(rng, ["x"], 1, 1, 0)[0][2:])] * 2
    frame = spark.createDataFrame(rows, KIND).repartition(3)
    assert sorted(map(tuple, similarity.close_pairs(frame, threshold, block=30).collect())) == [p for p in brute(rows, threshold) if p[1] != p[2]]


def test_pivots_compare_few_pairs_of_clustered_rows(spark):
    rows = signatures(random.Random(3), ["p"], 3000, 60, 3)
    frame = spark.createDataFrame(rows, KIND)
    assert compared(similarity.pivot_cells(frame, 10, 100)) < 0.1 * 3000 * 2999 / 2
    # at random nothing is gained, so rows stay in one cell and are compared in blocks
    mixed = spark.createDataFrame(signatures(random.Random(4), ["p"], 500, 0, 0), KIND)
    assert similarity.pivot_cells(mixed, 20, 100).select("_cell").distinct().count() == 1


def test_folds_of_units_without_rows(spark):
    empty = order.none("unit string, n long, ok boolean, x double")
    assert [str(t) for t in empty.dtypes] == ["object", "int64", "bool", "float64"]
    pool = spark.createDataFrame([("u", "x"), ("u", "y"), ("w", "z")], "unit string, id string")
    ops = spark.createDataFrame([("orphan", 0, "pick", "m", "x")], "unit string, seq long, type string, mid string, winner string")
    out = ranking.rank_from_log(pool, ops, 1, 1).collect()
    assert sorted((r.unit, r.id) for r in out) == [("u", "x"), ("u", "y"), ("w", "z")]
    assert ranking.rank_from_log(pool.limit(0), ops, 1, 1).collect() == []
    links = spark.createDataFrame([("x", "y", 1)], "a string, b string, sign int")
    none = spark.createDataFrame([], KIND)
    assert similarity.cluster(none, 4, links=links).collect() == [] and similarity.spanning_forest(similarity.close_pairs(none, 20)).count() == 0


def test_running_sums_of_few_and_many_rows_are_equal(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randint(0, 5)) for i in range(500)]
    path = fresh_path(spark, "few")
    spark.createDataFrame(rows, "unit string, id long, n long").write.parquet(path)
    frame = spark.read.parquet(path)
    for by in ([], ["unit"]):
        few, many = (order.running(frame, by, [F.col("id").desc()], "n", few_bytes=b) for b in (None, 0))
        assert few.columns == many.columns and few.dtypes == many.dtypes
        key = lambda r: r[1]
        assert sorted(map(tuple, few.collect()), key=key) == sorted(map(tuple, many.collect()), key=key)


def test_open_triples_around_hubs(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(200)} | {(0, k) for k in range(1, 40)}
    near = {(u, a, b) for u in ("u", "v") for a, b in pairs if u == "u" or (a + b) % 3}
    want = sum(1 for u in ("u", "v") for b in range(40) for a in range(40) for c in range(a + 1, 40) if len({a, b, c}) == 3 and (u, *sorted((a, b))) in near and (u, *sorted((b, c))) in near and (u, a, c) not in near)
    frame = spark.createDataFrame(sorted(near), "unit string, a long, b long")
    assert similarity.open_triples(frame, frame, 20).first()[0] == want
    assert similarity.open_triples(frame.limit(0), frame, 20).first()[0] == 0
    # five thousand million triples around one row are never rows
    hub = spark.range(1, 100_001).select(F.lit("u").alias("unit"), F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert similarity.open_triples(hub, hub, 20).first()[0] == 100_000 * 99_999 // 2


@pytest.mark.parametrize("radius", [0.0, 0.5, 30.0, 900.0, 30_000.0])
def test_leaders_on_a_grid_equal_leaders_among_all(radius):
    rng = np.random.default_rng(3)
    spots = np.concatenate([rng.uniform([-90, -180], [90, 180], (60, 2)), [[89.99, 0], [89.99, 179], [0, 179.99], [0, -179.99], [-89.9, 20], [45, 7]]])
    at = np.concatenate([spots[rng.integers(len(spots), size=900)] + rng.normal(0, 0.05, (900, 2)), rng.uniform([-90, -180], [90, 180], (300, 2))])
    lat, lon = np.clip(at[:, 0], -90, 90), at[:, 1]
    assert geo.leaders(lat, lon, radius, few=3).tolist() == geo.leaders(lat, lon, radius, few=10**9).tolist()


def test_leaders_take_time_linear_in_rows():
    rng = np.random.default_rng(4)
    lat, lon = rng.uniform(-60, 60, 30_000), rng.uniform(-180, 180, 30_000)
    began = time.perf_counter()
    label = geo.leaders(lat, lon, 5.0)
    assert label.max() > 20_000 and time.perf_counter() - began < 30
    lat[7] = np.nan
    assert len(geo.leaders(lat[:200], lon[:200], 5.0)) == 200


def test_centres_equally_far_are_told_apart_as_by_sql(spark):
    """Running means and the C library's sines, step by step: users whose rows lay between two centres went to the other one (0.1 GB of events)."""
    import duckdb

    import __spark_entry__ as e

    path = fresh_path(spark, "tied").removeprefix("file://")
    # the users of the copies that differed, rebuilt from the small table with shifted keys
    db = duckdb.connect()
    src = "/root/testdata/sf0.1/events.parquet"
    db.sql(f"CREATE TABLE events AS SELECT * REPLACE (event_id + 100000 * k AS event_id, user_id + 1500 * k AS user_id) FROM '{src}', (VALUES (2, 183), (2, 350), (4, 719)) v(k, u) WHERE user_id = u")
    import pathlib

    pathlib.Path(path).mkdir(parents=True)
    db.sql(f"COPY events TO '{path}/events.parquet'")
    got, want = e.queries()["location_clusters"](spark, f"file://{path}").collect(), db.sql(e.oracle_sql()["location_clusters"]).fetchall()
    assert sorted(tuple(r[c] for c in ("unit", "cluster", "n", "lat", "lon")) for r in got) == sorted(want)


def test_reviewed_groups_without_sharpness_equal_their_sql(spark):
    """Members whose sharpness is 0 throughout (ids divisible by 17) are equal in the SQL: 0 / 0 is no number there."""
    import pathlib

    import duckdb

    import __spark_entry__ as e

    path = fresh_path(spark, "blurred").removeprefix("file://")
    pathlib.Path(path).mkdir(parents=True)
    db = duckdb.connect()
    db.sql("CREATE TABLE embeddings AS SELECT unnest([17, 34, 51, 21, 22, 23])::BIGINT AS vec_id, list_transform(range(64), lambda x: sin(x * 7)::FLOAT) AS embedding, unnest([0, 0, 0, 1, 1, 1])::INTEGER AS label")
    db.sql(f"COPY embeddings TO '{path}/embeddings.parquet'")
    got, want = e.queries()["reviewed_groups"](spark, f"file://{path}").collect(), db.sql(e.oracle_sql()["reviewed_groups"]).fetchall()
    assert sorted(tuple(r[c] for c in ("unit", "group_id", "id", "rep", "manual", "confirmed", "diameter")) for r in got) == sorted(want)
    assert {r.rep for r in got if r.unit == "0"} == {17}


def test_small_cells_are_no_small_blocks(spark):
    """Rows that no pivot parts stay one cell: a cell size of 2 must not deal each of them to a thousand pairs of blocks."""
    rows = signatures(random.Random(6), ["p"], 2000, 0, 0)
    frame = spark.createDataFrame(rows, KIND)
    began = time.perf_counter()
    assert sorted(map(tuple, similarity.close_pairs(frame, 20, block=2).collect())) == brute(rows, 20)
    assert time.perf_counter() - began < 60


def test_folds_from_signatures_equal_folds_from_distances():
    rng = random.Random(8)
    rows = signatures(rng, ["u"], 300, 12, 6)
    hi, lo = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
    sig = similarity._packed(hi, lo)
    d = np.bitwise_count(sig[:, None] ^ sig[None, :])
    for t in (0, 4, 9, 20):
        assert similarity.strict_labels_of(sig, t).tolist() == similarity.strict_labels(d, t).tolist()
        assert similarity.union_labels_of(sig, t).tolist() == similarity.union_labels(d <= t).tolist()


def test_folds_and_corrections_hold_rows_not_their_square():
    """All distances of 12,000 rows, or links of 12,000 groups with each other, would take hundreds of MB."""
    import tracemalloc

    n = 12_000
    sig = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    tracemalloc.start()
    label = similarity.strict_labels_of(sig, 10)
    got = similarity.correct(label, {(0, 1)}, [(0, n - 1), (5, 6)])
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    assert got[0] == got[n - 1] and got[5] == got[6]


def test_forest_of_blocks_is_the_forest_of_all_pairs(spark, grouped):
    want = sorted(similarity.spanning_forest(similarity.close_pairs(grouped, 20)).collect())
    assert sorted(similarity.near_forest(grouped, 20, block=50).collect()) == want
    assert sorted(similarity.spanning_forest(similarity.close_pairs(grouped, 20), unit_pairs=700).collect()) == want


def test_score_of_all_pairs_makes_no_rows_of_pairs(spark, grouped):
    rows = grouped.withColumn("group_id", F.length("id") + F.substring("id", -1, 1).cast("int") % 3)
    same = lambda a, b: np.array([int(x[1:]) + int(y[1:]) for x, y in zip(a, b)], np.int64) % 2 == 0
    pairs = similarity.close_pairs(rows, 64).withColumn("same", (F.substring("a", 2, 9).cast("int") + F.substring("b", 2, 9).cast("int")) % 2 == 0)
    assert similarity.all_pairs_score(rows, same, block=40).collect() == similarity.clustering_score(pairs, rows).collect()
    assert similarity.all_pairs_score(rows.limit(0), same).first() == (0, 0, 0, 0)


def test_replays_and_image_work_are_dealt_to_tasks(spark, monkeypatch):
    """No group of its own for each small unit; a small file of records is more than one task's."""
    import __spark_entry__ as e

    plan = lambda q: e.queries()[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan("replayed_rankings")
    for q in ("image_hashes", "capture_roundtrip", "sniffed_kinds"):
        assert "Repartition" in plan(q)


def test_stacked_images_equal_single_ones():
    import pandas as pd

    from winnowlane.functions import signature

    rng = np.random.default_rng(2)
    sides = [(20, 30), (20, 30), (9, 8), (2, 5), (300, 400)] * 3
    grey = [rng.integers(0, 256, h * w).astype(np.float32) for h, w in sides] + [np.ones(1, np.float32), None]
    sides += [(20, 30)] * 2
    args = [pd.Series(x) for x in (pd.Series(grey, dtype=object), [w for _, w in sides], [h for h, _ in sides])]
    turns = [pd.Series([i % 4 for i in range(len(grey))]), pd.Series([i % 2 == 0 for i in range(len(grey))])]
    for work, given in ((signature.image_features, args), (signature.derivatives, args + turns)):
        whole = work.func(*given)
        single = pd.concat([work.func(*(a.iloc[i : i + 1] for a in given)) for i in range(len(grey))], ignore_index=True)
        flat = lambda f: [[None if x is None or x != x else float(x) if isinstance(x, (int, float, np.number)) else x for x in r] for r in f.itertuples(index=False, name=None)]
        assert flat(whole) == flat(single) and whole.err.notna().sum() == 2
    assert signature._stacked(*args, [()] * len(grey), lambda g: [signature.gradient_hash(x) for x in g])[0] == signature.gradient_hash(grey[0].reshape(20, 30))


def test_suffixes_ranked_by_several_symbols_at_once():
    from winnowlane.llm import suffix

    rng = np.random.default_rng(5)
    for n in range(40):
        base = [rng.integers(0, (2, 5, 256)[n % 3], rng.integers(1, 70)) for _ in range(4)]
        t = np.concatenate([x for i in range(1 + n) for x in (base[rng.integers(4)][rng.integers(2) :], [256 + i])]).astype(np.int64)
        assert suffix.first_ranks(t, 256) is not None
        assert suffix.suffix_rows(t, 256).tolist() == suffix.suffix_rows(t).tolist()
    assert suffix.first_ranks(np.array([1, 257, 1, 256]), 256) is None


def test_pieces_are_ranked_in_shares_of_whole_grams_and_to_the_length_that_counts():
    from winnowlane.llm import suffix

    rng = np.random.default_rng(8)
    base = rng.integers(97, 100, 90)
    t = np.concatenate([np.r_[base[a : a + rng.integers(50, 73)], 256 + k] for k, a in enumerate(rng.integers(0, 20, 60))]).astype(np.int64)
    rows, bound = suffix.expand(t, 256, 50)
    cut = lambda i: tuple(t[i : i + 50]) if i + 50 <= len(t) and not (t[i : i + 50] >= 256).any() else (i,)
    assert sorted(rows.tolist()) == list(range(len(t)))
    assert all(new == (cut(a) != cut(b)) for a, b, new in zip(rows[:-1], rows[1:], bound[1:]))
    rank, order, n = suffix.dense(np.array([5, 3, 5, 3], np.uint64), 3, np.array([False, False, True, True]))
    assert (rank.tolist(), order.tolist(), n) == ([2, 0, 3, 1], [1, 3, 0, 2], 4)
    kind = np.sort(rng.integers(0, 400, 9000))
    size = rng.integers(51, 74, 9000)
    size[kind == 7] = 5000
    got = list(suffix.shares(np.arange(9000), kind, size))
    assert np.concatenate(got).tolist() == list(range(9000)) and len(got) > 5
    assert all(kind[a[-1]] != kind[b[0]] for a, b in zip(got, got[1:]))
    assert all(size[x].sum() <= suffix.SYMBOLS or len(set(kind[x].tolist())) == 1 for x in got)


def test_least_grams_are_the_same_in_every_share():
    from winnowlane.llm import suffix
    from winnowlane.llm import _bytes as B

    data = np.tile(np.random.default_rng(9).integers(97, 123, 40_000).astype(np.uint8), 3)
    grams, at = suffix.least_grams(data, 28, 23)
    assert grams.tolist() == B.FIRST.bytes_windows(data, 28).tolist()
    runs = np.lib.stride_tricks.sliding_window_view(grams >> np.uint64(16), 23)
    assert at.tolist() == (runs.argmin(axis=1) + np.arange(len(at))).tolist()
    assert [len(x) for x in suffix.least_grams(data[:50], 28, 23)] == [23, 1]


def test_pairs_of_places_are_made_by_many_tasks(spark):
    from winnowlane import queries

    made = queries.haversine_pairs(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id().alias("task")).count().collect()
    n = sum(r["count"] for r in made)
    assert len(made) >= 4 and n == 150 * 149 // 2 and max(r["count"] for r in made) < n / 2


def test_pairs_of_places_come_block_by_block_and_keep_their_dictionaries(spark, tmp_path, monkeypatch):
    from winnowlane import queries

    # before, the first page of b held no id twice, and its dictionary was given up
    queries.haversine_pairs(spark, "/root/testdata/sf0.01").write.option("parquet.page.row.count.limit", 100).parquet(str(tmp_path / "out"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")]
    assert sum(m.num_rows for m in files) == 150 * 149 // 2
    assert all("PLAIN" not in m.row_group(k).column(c).encodings for m in files for k in range(m.num_row_groups) for c in (0, 1))
    places = [(u, None if u % 7 == 0 else u * 1.5 - 60, u * 3.0 - 120) for u in range(80)]
    rows = spark.createDataFrame([*places, (None, 1.0, 1.0)], "unit long, lat double, lon double")
    for size, least in ((512, 16), (3, 2), (512, 1)):
        monkeypatch.setattr(geo, "PAIR_BLOCK", size)
        monkeypatch.setattr(geo, "PAIR_BLOCKS", least)
        got = {(r.a, r.b): r.km for r in geo.pair_distances(rows).collect()}
        assert len(got) == 80 * 79 // 2 and all(a < b for a, b in got)
        # without a position the distance is as of the SQL, whose least() goes by the 1 alone
        assert all(math.isclose(km, math.pi * geo.EARTH_KM if None in (places[a][1], places[b][1]) else geo._km_one(*places[a][1:], *places[b][1:]), abs_tol=1e-6) for (a, b), km in got.items())
    assert geo.pair_distances(rows.where("unit < 0")).count() == 0


def test_triangles_are_told_by_signatures_without_a_row_for_two_followers(spark, monkeypatch):
    rng = random.Random(11)
    heads = [rng.getrandbits(64) for _ in range(4)]
    sig = {(u, i): heads[rng.randrange(4)] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 14))) for u in ("u", "v", None) for i in range(60)}
    rows = spark.createDataFrame([(u, i, s >> 32, s & 0xFFFFFFFF) for (u, i), s in sig.items()] + [("u", 99, None, None)], "unit string, id long, hi long, lo long")
    near = {(u, a, b) for u, a in sig for w, b in sig if u is not None and u == w and a != b and bin(sig[u, a] ^ sig[u, b]).count("1") <= 20}
    want = sum(1 for u, a, b in near for c in range(a + 1, 60) if (u, b, c) in near and (u, a, c) not in near)
    pairs = similarity.close_pairs(rows, 20)
    for tile in (similarity.TILE, 7):
        table = pa.table({"unit": ["u"] * 40 + ["v"] * 40, "low": ([1] * 25 + [2] * 15) * 2, "print": pa.array([np.array(s, np.uint64).view(np.int64).item() for s in list(sig.values())[:80]], pa.int64())})
        monkeypatch.setattr(similarity, "TILE", tile)
        of = lambda x, y: sum(bin(s ^ t).count("1") <= 20 for k, s in enumerate(list(sig.values())[x:y]) for t in list(sig.values())[x:y][:k])
        assert similarity._closed(table, 20).column("closed").to_pylist() == [of(0, 25) + of(25, 40) + of(40, 65) + of(65, 80)]
    monkeypatch.setattr(similarity, "FOLLOWERS", 50)
    assert want > 0 and similarity.open_triples(pairs, rows, 20).first()[0] == want
    assert similarity.open_triples(pairs, rows.select("unit", "id"), 20).first()[0] == want
    # 1,200 rows alike close 287 million triples: before, each was a row of two joins
    alike = spark.range(1200).select(F.lit("u").alias("unit"), "id", F.lit(5).cast("long").alias("hi"), F.lit(9).cast("long").alias("lo"))
    assert similarity.open_triples(similarity.close_pairs(alike, 20), alike, 20).first()[0] == 0
