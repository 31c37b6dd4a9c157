"""Grouping by ordered categories with named buckets for missing values, and gap events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowlane.functions import capture
from winnowlane.functions.text import path_segment
from winnowlane.operators.order import ranges
from winnowlane.scratch import materialize

# The gap and radius of a grouping that names none, and the categories.
GAP_HOURS, RADIUS_KM = 2.0, 5.0
CATEGORIES = ("folder", "year", "month", "day", "event", "location", "camera", "lens", "focal", "orientation", "format")


def normal_categories(wanted: list[str] | None) -> list[str]:
    """Known categories, the first of each. An empty list is a choice: one group of all."""
    return [c for c in dict.fromkeys(wanted or []) if c in CATEGORIES]


def normal_spec(spec: dict | None) -> dict:
    """categories, gap_hours, radius_km and names of a grouping, with defaults for what is missing or not positive."""
    spec = spec or {}
    over = lambda x, least: x if x and x > 0 else least
    return {"categories": normal_categories(spec.get("categories")), "gap_hours": over(spec.get("gap_hours"), GAP_HOURS), "radius_km": over(spec.get("radius_km"), RADIUS_KM), "names": dict(spec.get("names") or {})}


def keeps_folders(wanted: list[str] | None) -> bool:
    """Whether folders stay as they are: no choice at all, or the folder alone."""
    return wanted is None or normal_categories(wanted) == ["folder"]


def labelled(rows: DataFrame, category: str, value: Column) -> Column:
    """The safe label of a category's value; its missing bucket where it is null or empty."""
    v = F.nullif(value.cast("string"), F.lit(""))
    if category == "folder":  # real folders keep their depth; the root adds no segment
        parts = F.filter(F.split(F.coalesce(v, F.lit("")), "/"), lambda x: x != "")
        return F.nullif(F.array_join(F.transform(parts, path_segment), "/"), F.lit(""))
    return F.when(v.isNull(), F.lit(capture.missing_label(category))).otherwise(path_segment(v))


def group_key(rows: DataFrame, categories: dict[str, Column]) -> Column:
    """Labels of all levels, joined by slashes."""
    return F.concat_ws("/", *[labelled(rows, k, v) for k, v in categories.items()])


def group_counts(rows: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """group_key and n of every group: one shuffle, with counts before it."""
    return rows.groupBy(group_key(rows, categories).alias("group_key")).agg(F.count("*").alias("n"))


def assign_groups(rows: DataFrame, categories: dict[str, Column] | None, column: str = "dir") -> DataFrame:
    """Rows with a synthetic folder; the same frame if folders are to stay."""
    return rows if not categories else rows.withColumn(column, group_key(rows, categories))


def category_summary(rows: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """category, n_values, n_missing and n_groups of each category, all in one pass."""
    parts = []
    for k, v in categories.items():
        x = F.coalesce(v.cast("string"), F.lit("")) if k == "folder" else F.nullif(v.cast("string"), F.lit(""))
        parts += [F.count_distinct(x).alias(f"{k}_values"), F.count_if(x.isNull()).alias(f"{k}_missing")]
    one = rows.agg(*parts)
    stacked = ", ".join(f"'{k}', `{k}_values`, `{k}_missing`" for k in categories)
    out = one.selectExpr(f"stack({len(categories)}, {stacked}) AS (category, n_values, n_missing)")
    return out.withColumn("n_groups", F.col("n_values") + (F.col("n_missing") > 0).cast("int"))


def category_values(when: str = "taken", event: str = "event_label", place: str = "place") -> dict[str, Column]:
    """The value of every category of rows with the columns of a record (dir, taken, make, model, lens, fl35, fl, w, h, r, kind, ...)."""
    c = F.col
    iso = c(when)
    return {
        "folder": c("dir"), "year": capture.year_of(iso), "month": capture.month_of(iso), "day": capture.day_of(iso), "event": c(event), "location": c(place), "camera": capture.camera_label(c("make"), c("model")),
        "lens": c("lens"), "focal": capture.focal_band(c("fl35"), c("fl")), "orientation": capture.orientation(c("w"), c("h"), c("r")), "format": capture.format_label(c("kind")),
    }


def no_capture(rows: DataFrame, was_read: Column) -> DataFrame:
    """One row, n: records whose metadata were never read."""
    return rows.agg(F.count_if(~F.coalesce(was_read, F.lit(False))).alias("n"))


def gap_events(rows: DataFrame, when: str, key: str, gap_hours: float, by: list[str] | None = None) -> DataFrame:
    """Adds event_no and event_label: a new event begins where the gap to the record before is larger.

    Records are taken in the order of time and key; a gap of exactly the limit does not part them. Records
    without a time have no event. ``by`` keeps streams apart. Without it all rows are one stream, which
    is dealt by time over the session's partitions: each sees its own gaps, and one row a partition
    (its first and last time, its number of starts) ties them together.
    """
    if not by:
        return _gap_events_of_one(rows, when, key, gap_hours)
    order = Window.partitionBy(*by).orderBy(F.col(when).asc_nulls_last(), key)
    wait = _micros(F.col(when)) - _micros(F.lag(when).over(order))
    starts = F.when(F.col(when).isNull(), 0).when(wait.isNull() | (wait > int(gap_hours * 3_600_000_000)), 1).otherwise(0)
    numbered = rows.withColumn("_starts", starts).withColumn("event_no", F.when(F.col(when).isNotNull(), F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    first = F.min(when).over(Window.partitionBy(*by, "event_no"))
    return numbered.withColumn("event_label", F.when(F.col(when).isNotNull(), F.date_format(first, "yyyy-MM-dd HH.mm"))).drop("_starts")


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def _gap_events_of_one(rows: DataFrame, when: str, key: str, gap_hours: float) -> DataFrame:
    limit = int(gap_hours * 3_600_000_000)
    dealt = ranges(rows.where(F.col(when).isNotNull()), [F.col(when), F.col(key)])
    own = Window.partitionBy("_part").orderBy(when, key)
    wait = _micros(F.col(when)) - _micros(F.lag(when).over(own))
    marked = dealt.withColumn("_starts", F.when(wait > limit, 1).otherwise(0)).withColumn("_run", F.sum("_starts").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    marked = materialize(marked, "gaps")
    # one row a partition; a window over them is as small as the number of partitions
    ends = marked.groupBy("_part").agg(F.min(when).alias("_low"), F.max(when).alias("_high"), F.sum("_starts").alias("_n"))
    line = Window.orderBy("_part")
    step = _micros(F.col("_low")) - _micros(F.lag("_high").over(line))
    ends = ends.withColumn("_new", F.when(step.isNull() | (step > limit), 1).otherwise(0))
    before = F.sum(F.col("_new")).over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = marked.join(F.broadcast(ends.select("_part", before.alias("_before"))), "_part").withColumn("event_no", F.col("_before") + F.col("_run"))
    first = numbered.groupBy("event_no").agg(F.min(when).alias("_first"))
    out = numbered.join(first, "event_no").withColumn("event_label", F.date_format("_first", "yyyy-MM-dd HH.mm"))
    out = out.select(*rows.columns, "event_no", "event_label")
    timeless = rows.where(F.col(when).isNull()).select(*rows.columns, F.lit(None).cast("long").alias("event_no"), F.lit(None).cast("string").alias("event_label"))
    return out.unionByName(timeless)


def name_events(events: DataFrame, when: str, names: DataFrame) -> DataFrame:
    """Events with the names given to them (first, name) in place of their labels; two of one name are one group then."""
    firsts = events.where("event_no IS NOT NULL").groupBy("event_no").agg(F.min(when).alias("first"))
    given = firsts.join(names, "first").select("event_no", F.col("name").alias("_name"))
    return events.join(given, "event_no", "left").withColumn("event_label", F.coalesce("_name", "event_label")).drop("_name")


def event_sizes(events: DataFrame, when: str, by: list[str] | None = None) -> DataFrame:
    """Start, end and number of records of each event."""
    return events.where("event_no IS NOT NULL").groupBy(*(by or []), "event_no").agg(F.min(when).alias("started"), F.max(when).alias("ended"), F.count("*").alias("n"))


def session_sizes(rows: DataFrame, when: str, gap_hours: float, by: list[str]) -> DataFrame:
    """The same by Spark's session windows, without numbers: partial sessions merge before and after one shuffle."""
    gap = f"{int(gap_hours * 3600)} seconds"
    s = rows.where(F.col(when).isNotNull()).groupBy(*by, F.session_window(F.col(when), gap).alias("w"))
    return s.agg(F.min(when).alias("started"), F.max(when).alias("ended"), F.count("*").alias("n")).drop("w")


def time_order(when: str = "ts", key: str = "id") -> list[Column]:
    """Sort by time, missing last, then key."""
    return [F.col(when).asc_nulls_last(), F.col(key).asc()]


def missing_last(key: Column) -> list[Column]:
    """Sort groups by code point, those with a missing bucket in any level last."""
    return [key.rlike(capture.MISSING_SEGMENT).cast("int").asc(), key.asc()]
