"""Rates, quantiles and totals of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowlane.operators.order import running


def keep_rate(rows: DataFrame, by: Column, kept: Column, least: int = 5) -> DataFrame:
    """class, entered, kept and rate of classes with enough rows; rows without a class are left out."""
    g = rows.withColumn("class", by).where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("entered"), F.count_if(kept).alias("kept"))
    return g.where(F.col("entered") >= least).withColumn("rate", F.col("kept") / F.col("entered"))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median: the mean of the middle two of an even number; groups without a value have null.

    From counts of the distinct values and their running sums, as nearest_ranks(), so no task holds a group's values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    run = running(counted, by, [F.col(value)], "c")
    nth = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    found = run.groupBy(*by).agg(nth(low).alias("_a"), nth(high).alias("_b")).select(*by, ((F.col("_a") + F.col("_b")) / 2).alias("median"))
    return rows.select(*by).distinct().join(found, by, "left")


def nearest_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, p05, p25, median, p75, p95, max and mean, quantiles by the nearest rank of n - 1.

    Values are counted first; the running counts over them are made range by range (operators.order), so
    that a group of any number of values is shared among tasks.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    run = running(counted, by, [F.col(value)], "c")
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p + 0.5), F.col(value)))
    return run.groupBy(*by).agg(
        F.max("n").alias("n"), F.min(value).alias("min"), at(0.05).alias("p05"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), at(0.95).alias("p95"), F.max(value).alias("max"),
        (F.floor(F.sum(F.col(value) * F.col("c")) / F.sum("c") * 100 + 0.5) / 100).alias("mean"),
    )


def session_totals(entered: DataFrame, winners: DataFrame, passes: DataFrame, groups: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """One row of totals: rows that entered and came through, passes, screens, comparisons, rescued rows, groups, their rows and finalists, and overrides (pinned)."""
    a = entered.agg(F.count_distinct("id").alias("entered"))
    b = winners.agg(F.count_distinct("id").alias("finalists"))
    zero = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n)
    c = passes.agg(F.count("*").alias("passes"), zero("screens"), zero("comparisons"), *([zero("rescued")] if "rescued" in passes.columns else []))
    g = groups.join(groups.groupBy("unit", "group_id").agg(F.count("*").alias("n")).where("n > 1"), ["unit", "group_id"])
    d = g.agg(F.count_distinct("unit", "group_id").alias("burst_groups"), F.count("*").alias("burst_frames"))
    e = g.join(winners.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("burst_finalists"))
    f = [pinned.agg(F.count_distinct("id").alias("overrides"))] if pinned is not None else []
    out = a
    for one in (b, c, d, e, *f):  # frames of one row each
        out = out.crossJoin(F.broadcast(one))
    return out


def kind_counts(rows: DataFrame, kind: str = "kind") -> DataFrame:
    return rows.groupBy(kind).agg(F.count("*").alias("n"))


def group_counts(groups: DataFrame) -> DataFrame:
    """Number of groups of two and more, and rows in them."""
    n = groups.groupBy("unit", "group_id").agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def total_bytes(rows: DataFrame, size: str = "size") -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.coalesce(size, F.lit(0))), F.lit(0)).alias("bytes"))
