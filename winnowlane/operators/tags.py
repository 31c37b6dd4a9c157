"""Tags as two tables, names (tag_id, name, ord) and marks (id, tag_id), and edits of them as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnowlane.functions.text import tag_name

MOST_TAGS = 9


def add(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names with new ones (tag_id, name, ord) after them: none empty, none twice but for case, MOST_TAGS in all."""
    new = wanted.withColumn("name", tag_name(F.col("name"))).where("name != ''").withColumn("_new", F.lit(1))
    both = names.withColumn("_new", F.lit(0)).unionByName(new)
    first = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("_new", "ord", "tag_id"))
    once = both.withColumn("_n", first).where("_n = 1")
    # the tables of names are small: MOST_TAGS rows
    return once.orderBy("_new", "ord", "tag_id").limit(MOST_TAGS).drop("_new", "_n")


def rename(names: DataFrame, tag_id: str, name: str) -> DataFrame:
    """A tag renamed, unless another has that name but for case, or it is empty."""
    new = tag_name(F.lit(name))
    taken = names.where((F.col("tag_id") != tag_id) & (F.lower("name") == F.lower(new))).limit(1).select(F.lit(True).alias("taken"))
    out = names.join(F.broadcast(taken), F.lit(True), "left")
    return out.withColumn("name", F.when((F.col("tag_id") == tag_id) & F.col("taken").isNull() & (new != ""), new).otherwise(F.col("name"))).drop("taken")


def remove(names: DataFrame, marks: DataFrame, tag_id: str) -> tuple[DataFrame, DataFrame]:
    """A tag goes, and its marks with it."""
    return names.where(F.col("tag_id") != tag_id), marks.where(F.col("tag_id") != tag_id)


def put(marks: DataFrame, rows: DataFrame, tag_id: str, on: bool = True) -> DataFrame:
    """Marks with a tag set on, or taken from, the given rows."""
    rest = marks.join(rows.select("id", F.lit(tag_id).alias("tag_id")), ["id", "tag_id"], "left_anti")
    return rest.unionByName(rows.select("id", F.lit(tag_id).alias("tag_id")).distinct()) if on else rest


def toggle(marks: DataFrame, rows: DataFrame, tag_id: str) -> DataFrame:
    """Taken from all rows if all have the tag, else set on all."""
    asked = rows.select("id").distinct()
    full = asked.join(marks.where(F.col("tag_id") == tag_id), "id", "left_anti").limit(1).count() == 0
    return put(marks, asked, tag_id, not full)


def counts(names: DataFrame, marks: DataFrame) -> DataFrame:
    n = marks.groupBy("tag_id").agg(F.count("*").alias("n"))
    return names.join(n, "tag_id", "left").select("tag_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(names: DataFrame, marks: DataFrame, rows: DataFrame) -> DataFrame:
    """For each tag: whether all, some or none of the rows have it."""
    asked = rows.select("id").distinct()
    n = marks.join(asked, "id", "left_semi").groupBy("tag_id").agg(F.count("*").alias("n"))
    total = asked.agg(F.count("*").alias("total"))
    out = names.join(n, "tag_id", "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("tag_id", F.when((F.col("n") == 0) | (F.col("total") == 0), "none").when(F.col("n") == F.col("total"), "all").otherwise("some").alias("coverage"))


def with_tag(rows: DataFrame, marks: DataFrame, tag_id: str) -> DataFrame:
    """Rows that have a tag, in their own order."""
    return rows.join(marks.where(F.col("tag_id") == tag_id), "id", "left_semi")


def tag_list(marks: DataFrame, names: DataFrame) -> DataFrame:
    """id and tags: names in order, joined by semicolons."""
    m = marks.join(names, "tag_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("t"))
    return m.select("id", F.array_join(F.transform("t", lambda x: x["name"]), "; ").alias("tags"))
