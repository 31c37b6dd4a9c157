from pyspark.sql import functions as F

from winnowlane.operators import hierarchy as h


def rows(spark, folders):
    return spark.createDataFrame([(f"{d}/{i}", d) for d, n in folders.items() for i in range(n)], "id string, dir string")


def resolved(spark, folders, quotas):
    nodes, held = h.tree(rows(spark, folders))
    r = h.resolve(nodes, spark.createDataFrame(list(quotas.items()), "path string, raw string"))
    return held, r, h.units(r)


def test_worked_example(spark):
    held, r, found = resolved(spark, {"Trip/Day1": 80, "Trip/Day2": 120, "Trip/Day3": 150, "Trip/Day4": 90, "Trip/Misc": 40}, {"Trip": "20", "Trip/Day1": "5", "Trip/Day2": "5", "Trip/Day4": "0"})
    got = {x.unit_id: x.target for x in found.collect()}
    assert got == {"fixed:Trip/Day1": 5, "fixed:Trip/Day2": 5, "pooled:Trip": 10}
    n = {x.unit_id: x["count"] for x in h.members(held, r, found).groupBy("unit_id").count().collect()}
    assert n == {"fixed:Trip/Day1": 80, "fixed:Trip/Day2": 120, "pooled:Trip": 190}
    assert h.projected_total(found).head()[0] == 20 and h.issues(r, found).count() == 0


def test_issues_and_loose_rows(spark):
    held, r, found = resolved(spark, {"T": 10, "T/A": 3, "T/B": 4}, {"T": "*", "T/A": "9"})
    codes = {(x.path, x.code) for x in h.issues(r, found).collect()}
    assert codes == {("T/A", "clamped"), ("T/B", "dead-pool"), ("T/__loose__", "dead-pool")}
    _, r, found = resolved(spark, {"a/b/c": 12}, {})
    assert [x.code for x in h.issues(r, found).collect()] == ["root-unallocated"]


def test_percent_and_text(spark):
    f = spark.createDataFrame([(5.0, 746, 37), (50.0, 7, 4), (5.0, 12, 1), (0.0, 9, 0), (5.0, 0, 0)], "p double, n long, want long")
    assert all(x.want == x.got for x in f.select("want", h.percent_count(F.col("p"), F.col("n")).alias("got")).collect())
    raws = ["5", "", "*", "12.5%", "0", "abc", None]
    q = spark.createDataFrame([(r,) for r in raws], "raw string").select(h.parse_quota(F.col("raw")).alias("q")).select("q.*")
    assert [x.mode for x in q.collect()] == ["fixed", "pooled", "uncapped", "percent", "excluded", "invalid", "pooled"]


def test_apportion_sums_and_caps(spark):
    kids = spark.createDataFrame([("p", f"k{i}", i, c) for i, c in enumerate([3, 2, 50, 500])], "parent_path string, path string, ord int, subtree_count long")
    for total, even in ((20, True), (20, False), (54, True), (1000, True)):
        got = {x.path: x.places for x in h.apportion(kids, total, even).collect()}
        assert sum(got.values()) == min(total, 555) and all(got[f"k{i}"] <= c for i, c in enumerate([3, 2, 50, 500]))
