"""Texts, labels and rules on values whose results are known."""

import pytest
from pyspark.sql import functions as F

from winnowlane.functions import capture, text
from winnowlane.operators import hierarchy, ranking, similarity, staged

SIZES = [(0, "0 B"), (None, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (10239, "10.0 KB"), (10240, "10 KB"), (1048576, "1.0 MB"), (52428800, "50 MB"), (5368709120, "5.0 GB"), (1099511627776, "1.0 TB"), (2251799813685248, "2048 TB")]
TIMES = [(0, "0s"), (499, "0s"), (500, "1s"), (59499, "59s"), (59500, "1m 0s"), (125000, "2m 5s"), (7325000, "122m 5s")]
SHARES = [(1, 3, "33%"), (1, 2, "50%"), (1, 8, "13%"), (0, 0, "0%"), (5, 5, "100%")]
RAWS = [
    ("5", "fixed", 5), ("0", "excluded", None), ("", "pooled", None), (" * ", "uncapped", None), ("∞", "uncapped", None), ("INF", "uncapped", None), ("5%", "percent", 5), ("12.5%", "percent", 12.5), ("5 %", "percent", 5), ("100%", "percent", 100), ("0%", "excluded", None),
    ("abc", "invalid", None), ("-3", "invalid", None), ("2.5", "invalid", None), ("101%", "invalid", None), ("%", "invalid", None), ("5%%", "invalid", None), (".5%", "percent", 0.5), ("0005%", "invalid", None), ("005%", "percent", 5), ("007", "fixed", 7), ("5.%", "invalid", None), ("000", "excluded", None), ("1e3", "invalid", None),
]
AGAIN = [("5", "5"), ("0", "0"), ("", ""), ("*", "*"), ("12.5%", "12.5%"), ("100%", "100%"), ("nonsense", ""), ("∞", "*"), ("007", "7")]
CLAMPED = [(-3.0, 4), (4.4, 4), (4.5, 6), (5.0, 6), (6.49, 6), (6.5, 8), (13.0, 14), (14.0, 14), (19.2, 20), (99.0, 20)]
LEFT = [((16, 3, 1, 8, 0, 16), 32), ((0, 0, 0, 8, 8, 16), 0), ((4, 1, 1, 5, 2, 64), 11), ((1, 0, 0, 1, 0, 1), 0), ((2, 5, 0, 2, 1, 2), 0)]
LABELS = [
    (("one", 9, None, 0.5, None, None), ("Keep 1", "no limit", "30 min", "not set")), (("custom", 3, 3, 2.0, "unlimited", None), ("Keep up to 3", "keep at most 3", "2 h", "unlimited")), (("half", 9, 4, 24.0, "pct", 10.0), ("Keep up to half", "keep at most 4", "24 h", "10% of 37 = 4")),
    (("unlimited", 9, None, 1.5, "fixed", 20.7), ("Unlimited", "no limit", "1.5 h", "20")), (("custom", 1, 1, 1.0, "fixed", -3.0), ("Keep up to 1", "keep at most 1", "1 h", "0")), (("one", 9, None, 1.0, "fixed", 90.0), ("Keep 1", "no limit", "1 h", "37")),
]


def shown(spark, rows, schema, column):
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("x")).orderBy("i").collect()
    return [r.x for r in got]


def test_number_texts(spark):
    assert shown(spark, [(n,) for n, _ in SIZES], "n long", text.bytes_text(F.col("n"))) == [x for _, x in SIZES]
    assert shown(spark, [(n,) for n, _ in TIMES], "n long", text.duration_text(F.col("n"))) == [x for _, x in TIMES]
    assert shown(spark, [(a, b) for a, b, _ in SHARES], "a long, b long", text.percent_text(F.col("a"), F.col("b"))) == [x for *_, x in SHARES]


def test_quotas_as_typed(spark):
    q = shown(spark, [(r,) for r, *_ in RAWS], "raw string", hierarchy.parse_quota(F.col("raw")))
    assert [(x.mode, x.value) for x in q] == [(m, v) for _, m, v in RAWS]
    p = hierarchy.parse_quota(F.col("raw"))
    assert shown(spark, [(r,) for r, _ in AGAIN], "raw string", hierarchy.quota_text(p["mode"], p["value"])) == [x for _, x in AGAIN]


def test_thresholds_offered(spark):
    assert shown(spark, [(t,) for t, _ in CLAMPED], "t double", similarity.clamp_threshold(F.col("t"))) == [x for _, x in CLAMPED]


def test_labels(spark):
    c = F.col
    column = F.array(staged.quota_text(c("m"), c("n")), staged.cap_text(c("cap")), staged.gap_text(c("gap")), staged.rescue_text(c("rm"), c("rv"), F.lit(37)))
    assert shown(spark, [x for x, _ in LABELS], "m string, n long, cap long, gap double, rm string, rv double", column) == [list(x) for _, x in LABELS]


def test_comparisons_left(spark):
    names = ["entrants", "decided", "reused", "target", "placed", "field_size"]
    got = shown(spark, [x for x, _ in LEFT] + [(0, 0, 0, 3, 0, 2**k) for k in range(20)], ", ".join(f"{n} long" for n in names), ranking.left_to_ask_expr(*map(F.col, names)))
    assert got == [n for _, n in LEFT] + [ranking.left_to_ask(0, 0, 0, 3, 0, 2**k) for k in range(20)]
    assert [ranking.left_to_ask(*x) for x, _ in LEFT] == [n for _, n in LEFT]


def test_all_turns(spark):
    rows = [(r1, f1, r2, f2) for r1 in range(4) for f1 in (False, True) for r2 in range(4) for f2 in (False, True)]
    got = shown(spark, rows, "r1 int, f1 boolean, r2 int, f2 boolean", capture.compose_turns(*map(F.col, ("r1", "f1", "r2", "f2"))))
    assert [(x.r, x.f) for x in got] == [((r2 - r1 if f2 else r2 + r1) % 4, f1 != f2) for r1, f1, r2, f2 in rows]


@pytest.mark.parametrize("even", [False, True])
def test_apportioning_with_caps(spark, even):
    """What full folders can't take goes to the others one by one in order, also where a parent has nothing to share or too much."""
    kids = [("p", f"p/{i}", i, n) for i, n in enumerate([50, 1, 3, 0, 20])] + [("q", "q/0", 0, 4), ("q", "q/1", 1, 4), ("r", "r/0", 0, 0)]
    frame = spark.createDataFrame(kids, "parent_path string, path string, ord int, subtree_count long")
    got = {r.path: r.places for r in hierarchy.apportion(frame, 40, even).collect()}
    assert got == ({"p/0": 18, "p/1": 1, "p/2": 3, "p/4": 18} if even else {"p/0": 27, "p/1": 0, "p/2": 2, "p/4": 11}) | {"q/0": 4, "q/1": 4}


def test_correction_edits(spark):
    """Merge, split, confirm and split all, as edits; what stood between the rows before goes."""
    g = spark.createDataFrame([("u", 1, 1), ("u", 1, 2), ("u", 1, 3), ("u", 4, 4), ("u", 4, 5), ("v", 6, 6), ("v", 6, 7)], "unit string, group_id long, id long")
    links = spark.createDataFrame([(1, 3, 1), (4, 5, -1), (6, 7, 1)], "a long, b long, sign int")
    pick = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    rows = lambda f: sorted((r.a, r.b, r.sign) for r in f.collect())
    assert rows(similarity.merge_edits(g, pick(2, 3, 4), links.where("a != 1"), 1)) == [(2, 4, 1), (4, 5, 0)]
    assert rows(similarity.split_edits(g, pick(2), links, 1)) == [(1, 2, -1), (1, 3, 0), (2, 3, -1)]
    assert rows(similarity.confirm_edits(g, "u", 1, 1)) == [(1, 2, 1), (1, 3, 1)]
    assert rows(similarity.split_all_edits(g, "u", 1, links, 1)) == [(1, 2, -1), (1, 3, -1), (1, 3, 0), (2, 3, -1)]
