import glob
import os

import pytest

D = "/root/testdata/sf0.001"
FAST = ["organize_day_type", "category_summary", "gap_events", "tree_rollup", "alloc_parse", "percent_count", "hamming_pairs", "group_representative", "nearest_place", "page_quota_topq", "schedule_projection", "rank_price", "bracket_topk", "winner_union", "keep_rate", "nearest_ranks", "csv_guard", "manifest"]


def plain(frame):
    out = frame[sorted(frame.columns)].astype(object)
    out = out.where(out.notna(), None)
    return sorted(repr([float(x) if isinstance(x, float) else x for x in r]) for r in out.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    db = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = e.queries()[name](spark, D).toPandas(), db.sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_cull_job(spark):
    from pyspark.sql import functions as F

    from winnowlane.plans.jobs import cull
    from winnowlane.sources import adapters

    s = adapters.signatures(spark, D).select("id", "hi", "lo")
    rows = adapters.customers_in_folders(spark, D).join(s, "id").withColumn("sharp", F.col("score")).withColumn("pixels", F.lit(1))
    out = cull(rows, spark.createDataFrame([("ASIA", "5"), ("AFRICA", "4")], "path string, raw string"))
    n = out["finalists"].groupBy("unit").count().collect()
    assert n and all(r["count"] <= 5 for r in n)
