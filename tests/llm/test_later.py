"""Resampling, decontamination and hard negatives against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(ASCII))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcXYZé9") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["İ", "名前", "\u0085"]
    prose = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate([30, 12, 10, 9, 1, 14, 3])] + [(7, None), (8, ""), (9, " .. "), (1, prose(11))]
    items += [(20, items[0][1]), (None, prose(15))]
    docs = [prose(rng.randint(1, 80)) for _ in range(60)]
    docs += [f"{prose(20)} {items[k][1]} {prose(5)} {items[j][1]}" for k in range(6) for j in (0, 2, 4)] + [items[0][1].upper()]
    docs += [None, "", "...", items[3][1], "x" * 5000 + " y", prose(20_000), items[12][1] * 3]
    rows = [(i, t) for i, t in enumerate(docs)]
    return rows + [rows[65], rows[65], (65, "another text"), (None, docs[61]), (None, None)], items


@pytest.fixture(scope="module")
def frames(spark, texts):
    docs = spark.createDataFrame(texts[0], "doc_id long, text string").withColumn("tokens", F.lit("x")).withColumn("hash", F.lit(1)).withColumn("n_chars", F.length("text").cast("long"))
    return docs.repartition(3).cache(), spark.createDataFrame(texts[1], "item_id long, text string").withColumn("len", F.lit("x"))


def features(t):
    w = words(t)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_crc_of_runs_is_composed():
    from winnowlane.llm import importance as I

    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 7, 63, 64, 65, 200, 5000]))) for _ in range(60)]
    data, at = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])
    crc = I.word_crcs(data, at[:-1], at[1:])
    assert crc.tolist() == [zlib.crc32(p) for p in parts]
    joined = I.shifted(crc[:-1], np.diff(at)[1:]) ^ crc[1:]
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:])]


@pytest.mark.parametrize("slab", [7, 1 << 20])
def test_importance(frames, texts, slab, monkeypatch):
    from winnowlane.llm import importance as I

    monkeypatch.setattr(I, "SLAB", slab)
    rows, items = texts
    crc = lambda t: [zlib.crc32(f.encode()) % 10_000 for f in features(t)]
    s, t = Counter(b for _, x in rows for b in crc(x)), Counter(b for _, x in items for b in crc(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    want = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in crc(x))
        want.append([i, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    fit = sorted((w for w in want if w[5] >= 20), key=lambda w: (-w[3], w[0] is None, w[0]))
    for k, w in enumerate(fit[: 30 * len(fit) // 100]):
        w[4] = k + 1
    key = lambda r: tuple((x is None, x) for x in r)
    out = I.rank(*frames, percent=30)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, out.collect()), key=key) == sorted((tuple(w[:5]) for w in want), key=key)
    drawn = I.resample(*frames, percent=30)
    assert drawn.columns == frames[0].columns
    assert sorted(((r.doc_id, len(features(r.text))) for r in drawn.collect()), key=key) == sorted(((w[0], w[1]) for w in want if w[4]), key=key)


def test_importance_edges(spark, frames):
    from winnowlane.llm import importance as I

    none = spark.createDataFrame([], "doc_id long, text string")
    assert I.rank(none, frames[1]).collect() == [] and I.resample(none, frames[1]).collect() == []
    assert I.rank(frames[0], none).count() == frames[0].count()
    # equal texts with equal noise at the border: as many as were drawn stay
    same = spark.createDataFrame([(5, "a b " * 20)] * 7, "doc_id long, text string")
    assert I.resample(same, frames[1], percent=50).count() == 3
    with pytest.raises(ValueError):
        I.weigh(same.withColumn("_words", F.lit(1)), [0])


def brute(rows, items, width=10):
    found = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in found}
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in found:
                    hit |= set(range(k, k + n))
                    ids |= found[x]
        yield i, t, len(w), hit, sorted(ids)


@pytest.mark.parametrize("broadcast", [500_000, 9])
def test_decontaminate(frames, texts, broadcast):
    from winnowlane.llm import decontaminate as D

    want = [(i, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)) for i, _, n, hit, ids in brute(*texts)]
    key = lambda r: tuple((x is None, x) for x in r)
    out = D.report(*frames, broadcast=broadcast)
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_decontaminate_removes_spans_or_documents(frames, texts):
    from winnowlane.llm import decontaminate as D

    exact = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut, whole = [], []
    for i, t, _, hit, _ in brute(*texts):
        if not hit:
            whole.append((i, t))
            cut.append((i, t))
            continue
        out, at = "", 0
        for k, m in enumerate(exact.finditer(t)):
            out += "" if k in hit else t[at : m.end()]
            at = m.end()
        cut.append((i, out + t[at:]))
    key = lambda r: tuple((x is None, x) for x in r)
    got = D.remove(*frames)
    assert got.columns == frames[0].columns
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=key) == sorted(cut, key=key)
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
    assert sorted(((r.doc_id, r.text) for r in D.remove(*frames, spans=False).collect()), key=key) == sorted(whole, key=key)


def test_decontaminate_edges(spark, frames):
    from winnowlane.llm import decontaminate as D

    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    assert D.report(none, frames[1]).collect() == []
    assert not D.report(frames[0], none).where("contaminated OR n_items > 0").count()
    # one pass over the text: the lookup is part of one stage of generated code, and no filter computes the windows once more
    plan = D.report(*frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(") == 1 and "BroadcastHashJoin" in plan and "Python" not in plan


def mined(rows, anchor, k=5, m=3):
    q = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, lab, v) in enumerate(q):
        if anchor(i):
            pos = sorted((-dot(v, w), j) for x, (j, lb, w) in enumerate(q) if x != n and lb == lab)[:k]
            for s, j in pos:
                s = -s
                neg = sorted((-t, y) for y, lb, w in q if lb != lab and 50 * s <= 100 * (t := dot(v, w)) <= 95 * s)[:m]
                out += [(i, j, r + 1, y, s, -t) for r, (t, y) in enumerate(neg)]
    return sorted(out)


def vectors(kind):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % 6]], rng.randrange(3)) for i in range(400)]
    if kind == "ties":  # a third is one vector, and components are few
        rows = [(i, [1.0] * 8 if i % 3 == 0 else [round(x) / 2 for x in v], lab) for i, v, lab in rows]
    if kind == "odd":
        rows += [(401, None, 1), (402, [None] * 8, 1), (403, [float("nan")] * 8, 2), (404, [float("inf")] * 8, 2), (405, [0.0] * 8, 1), (406, [], 1), (407, [1.0, 2.0], 0), (None, [1.0] * 8, 1), (400, [0.5] * 8, None), (408, [1e300] * 8, 1)]
        rows += [rows[50], rows[50], (50, rows[51][1], 2)]
    if kind == "large":
        rows = [(i, [x * 2e5 for x in v], lab) for i, v, lab in rows]
    return rows


@pytest.mark.parametrize("kind", ["plain", "ties", "odd", "large"])
@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, kind, small):
    from winnowlane.llm import hard_negatives as H

    rows = vectors(kind)
    params = {"block": 16, "chunk": 3, "pivots": 5, "sample": 64, "first": 1, "wider": 2} if small else {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("x")).withColumn("block", F.lit(1)).repartition(3)
    got = H.mine(frame, F.col("vec_id") % 50 == 0, **params)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    rows = [r for r in rows if r[0] != 408]  # its scores don't fit 64 bits
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 50 == 0)


def test_hard_negatives_look_at_part_of_the_index(spark):
    """On clustered vectors intervals of keys leave out most blocks."""
    from winnowlane.llm import hard_negatives as H

    rng = random.Random(8)
    centres = [[rng.gauss(0, 4) for _ in range(6)] for _ in range(40)]
    rows = [(i, [c + rng.gauss(0, 0.02) for c in centres[i % 40]], 0) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    index = H._Index(H.prepared(frame, F.col("vec_id") % 200 == 0), 40, 4000, 20, 1)
    seen = []
    keep = H.materialize
    try:
        H.materialize = lambda f, name: (out := keep(f, name), seen.append(out) if name == "search" else None)[0]
        opened = index.chunks.select(F.col("block").alias("chunk"), "n", "ids", "rows", "labels", "raw", F.lit(b"\x01" + b"\x00" * 6 + b"\x80").alias("low"), F.lit(b"\xff" * 7 + b"\x7f").alias("high"))
        best = H._search(index, opened, True, 5, 4, 4)
    finally:
        H.materialize = keep
    assert best.count() == 20 * 5
    looked = sum(f.select(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0] for f in seen)
    assert looked < 0.35 * 20 * len(index.block)


def test_hard_negatives_edges(spark):
    from winnowlane.llm import hard_negatives as H

    kind = "vec_id long, embedding array<float>, label int"
    assert H.mine(spark.createDataFrame([], kind), F.col("vec_id") == 0).collect() == []
    one = spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(20)], kind)
    assert H.mine(one, F.col("vec_id") == 0).collect() == [] and H.mine(one, F.col("vec_id") < 0).collect() == []
