"""Elimination in passes: dealing into pages, quotas, survivors, schedules and prices."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnowlane.functions.text import number_text
from winnowlane.operators.order import positions

# The shuffle's linear congruential generator, and seconds for a comparison, a page and each row on it.
LCG_A, LCG_C, LCG_M = 1664525, 1013904223, 2**32
SECONDS = {"comparison": 2.75, "page": 4.0, "row": 1.2}
#: A pass hands over at so many times the target, and there are at most so many passes.
HANDOFF, MOST_PASSES = 3, 9


def quota(mode: Column, page: Column, custom: Column) -> Column:
    """Rows that a page of so many may keep; null without limit."""
    half = F.greatest(F.lit(1), F.floor(page / 2))
    return F.when(mode == "one", F.lit(1)).when(mode == "custom", F.greatest(F.lit(1), F.least(custom, page))).when(mode == "unlimited", F.lit(None)).otherwise(half).cast("long")


def quota_text(mode: Column, custom: Column) -> Column:
    return F.when(mode == "one", "Keep 1").when(mode == "custom", F.concat(F.lit("Keep up to "), custom.cast("string"))).when(mode == "unlimited", "Unlimited").otherwise("Keep up to half")


def cap_text(limit: Column) -> Column:
    return F.when(limit.isNull(), "no limit").otherwise(F.concat(F.lit("keep at most "), limit.cast("string")))


def gap_text(hours: Column) -> Column:
    """A gap in minutes below an hour, else in hours."""
    return F.when(hours < 1, F.concat(number_text(hours * 60), F.lit(" min"))).otherwise(F.concat(number_text(hours), F.lit(" h")))


def tighter(mode: Column, custom: Column, page: Column) -> Column:
    """The next stricter quota, struct mode and custom: from unlimited to half, to one less than half of the page, one less each time, to one."""
    pick = lambda m, c: F.struct(F.lit(m).alias("mode"), c.cast("long").alias("custom"))
    below_half = pick("custom", F.greatest(F.lit(1), F.floor(page / 2) - 1))
    return F.when(mode == "unlimited", pick("half", custom)).when(mode == "half", below_half).when((mode == "custom") & (custom > 1), pick("custom", custom - 1)).otherwise(pick("one", F.lit(1)))


def shuffled(items: list, seed: int) -> list:
    """The seeded order in which a pass deals its rows; the same wherever it is replayed."""
    out, state = list(items), (seed % LCG_M) or 1
    for last in range(len(out) - 1, 0, -1):
        state = (state * LCG_A + LCG_C) % LCG_M
        at = state % (last + 1)
        out[last], out[at] = out[at], out[last]
    return out


def shuffle_expr(items: Column, seed: Column) -> Column:
    """The same order of an array as a native fold; quadratic in the array's length, so for pages and fields."""
    start = F.struct(F.when(F.pmod(seed, F.lit(LCG_M)) == 0, F.lit(1)).otherwise(F.pmod(seed, F.lit(LCG_M))).cast("long").alias("s"), items.alias("a"))

    def step(acc: Column, last: Column) -> Column:
        s = F.pmod(acc["s"] * LCG_A + LCG_C, F.lit(LCG_M)).cast("long")
        at = F.pmod(s, last + 1)
        swapped = F.transform(acc["a"], lambda x, i: F.when(i == last, F.get(acc["a"], at.cast("int"))).when(i == at, F.get(acc["a"], last.cast("int"))).otherwise(x))
        return F.struct(s.alias("s"), swapped.alias("a"))

    downward = F.when(F.size(items) > 1, F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(downward, start, step, lambda acc: acc["a"])


def shuffle_rows(rows: DataFrame, unit: str, key: str, seed: int) -> DataFrame:
    """unit, key and pos of the seeded order of each unit's rows, themselves taken in the order of ``ord``."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (unit, key)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        order = shuffled(pdf.sort_values("ord", kind="stable")[key].tolist(), seed)
        return pd.DataFrame({unit: pdf[unit].iloc[0], key: order, "pos": range(len(order))})

    return rows.groupBy(unit).applyInPandas(fold, f"{unit} {kinds[unit]}, {key} {kinds[key]}, pos long")


def spread(rows: DataFrame, unit: str, key: str, seed: int) -> DataFrame:
    """A random order without the generator's sequence: by hash, for units of any size."""
    return positions(rows, unit, [F.xxhash64(key, F.lit(seed)), F.col(key)]).drop("_n")


def faces(pool: DataFrame, groups: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """unit, id, face and pos: rows of a group of which two or more are in the pool stand behind one face.

    The face is the representative if it is in the pool, else the first in pool order (ord). ``groups``: unit, id, group_id.
    Rows without a group meet no other row: they are their own face where they are.
    """
    p = pool.join(groups.where("group_id IS NOT NULL").select("unit", "id", "group_id"), ["unit", "id"], "left")
    alone = p.where("group_id IS NULL").select("unit", "id", F.col("id").alias("face"), F.col("ord").alias("pos"), "ord")
    held = p.where("group_id IS NOT NULL")
    held = held.withColumn("is_rep", F.lit(False)) if reps is None else held.join(reps.select("id", F.lit(True).alias("is_rep")), "id", "left").withColumn("is_rep", F.coalesce("is_rep", F.lit(False)))
    best = held.groupBy("unit", "group_id").agg(F.count("*").alias("n"), F.min_by("id", F.struct(~F.col("is_rep"), "ord")).alias("first"), F.min("ord").alias("pos"))
    held = held.join(best, ["unit", "group_id"])
    one = F.col("n") > 1
    return alone.unionByName(held.select("unit", "id", F.when(one, F.col("first")).otherwise(F.col("id")).alias("face"), F.when(one, F.col("pos")).otherwise(F.col("ord")).alias("pos"), "ord"))


def pages(rows: DataFrame, unit: str, order: list[Column], size: int) -> DataFrame:
    """Adds pos, page (from 0), page_rows and pages; a unit of any size is dealt over many tasks (operators.order)."""
    out = positions(rows, unit, order).withColumn("page", F.floor(F.col("pos") / size))
    left = F.col("_n") - F.col("page") * size
    return out.withColumn("page_rows", F.least(F.lit(size).cast("long"), left)).withColumn("pages", F.ceil(F.col("_n") / size)).drop("_n")


def keep_per_page(paged: DataFrame, unit: str, score: list[Column], mode: str = "half", custom: int = 1) -> DataFrame:
    """Adds kept: on each page the best rows up to the page's quota."""
    best = F.row_number().over(Window.partitionBy(unit, "page").orderBy(*score))
    limit = quota(F.lit(mode), F.col("page_rows"), F.lit(custom))
    return paged.withColumn("kept", F.coalesce(best <= limit, F.lit(True)))


def over_quota(paged: DataFrame, chosen: DataFrame, unit: str, key: str, mode: str = "half", custom: int = 1) -> DataFrame:
    """Pages on which more rows were chosen than the quota allows; a pass with any is blocked."""
    n = paged.join(chosen.select(key), key, "left_semi").groupBy(unit, "page").agg(F.count("*").alias("chosen"), F.first("page_rows").alias("page_rows"))
    return n.where(F.col("chosen") > F.coalesce(quota(F.lit(mode), F.col("page_rows"), F.lit(custom)), F.col("chosen")))


def finish_pass(dealt: DataFrame, kept_faces: DataFrame, unit: str = "unit") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pool, cut and summary after a pass: rows follow their face. Summary: before, after, cut and cut_share (a fraction, not rounded) of each unit."""
    marked = dealt.join(kept_faces.select(unit, "face", F.lit(True).alias("kept")), [unit, "face"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    summary = marked.groupBy(unit).agg(F.count("*").alias("before"), F.count_if("kept").alias("after"), F.count_if(~F.col("kept")).alias("cut"))
    summary = summary.withColumn("cut_share", F.col("cut") / F.col("before"))
    return marked.where("kept").drop("kept"), marked.where("NOT kept").drop("kept"), summary


def standing(paged: DataFrame, page: int, kept: DataFrame, key: str = "id") -> DataFrame:
    """Rows left when a pass stops before a page: those kept so far, and those not yet seen."""
    seen_kept = paged.where(F.col("page") < page).join(kept.select(key), key, "left_semi")
    return seen_kept.unionByName(paged.where(F.col("page") >= page))


def low_cull(cut_share: Column, floor: Column) -> Column:
    """Whether a pass cut a smaller share than the floor; a floor of 0 is none."""
    return F.coalesce((floor > 0) & (cut_share < floor), F.lit(False))


def rescue_limit(mode: Column, value: Column, cut: Column) -> Column:
    """Rows that may come back: a number (whole, not below 0), a percentage (of 0 to 100, at least one of any, halves up), or no limit (null). Without a mode none may."""
    value = F.coalesce(value.cast("double"), F.lit(0.0))
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))
    share = F.when(pct == 0, F.lit(0)).otherwise(F.least(cut, F.greatest(F.lit(1), F.floor(cut * pct / 100.0 + 0.5))))
    return F.when(mode.isNull(), F.lit(0)).when(mode == "unlimited", F.lit(None)).when(mode == "pct", share).otherwise(F.least(cut, F.greatest(F.lit(0), F.floor(value)))).cast("long")


def rescue_text(mode: Column, value: Column, cut: Column) -> Column:
    n = rescue_limit(mode, value, cut).cast("string")
    return F.when(mode.isNull(), "not set").when(mode == "unlimited", "unlimited").when(mode == "pct", F.concat(number_text(value), F.lit("% of "), cut.cast("string"), F.lit(" = "), n)).otherwise(n)


def rescue(pool: DataFrame, cut: DataFrame, saved: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Saved rows move from the cut to the end of the pool."""
    back = cut.join(saved.select(key), key, "left_semi")
    return pool.unionByName(back, allowMissingColumns=True), cut.join(saved.select(key), key, "left_anti")


def pass_counters(paged: DataFrame, unit: str = "unit") -> DataFrame:
    """For each page that is being shown, its rows marked kept or not: remaining (this page's rows included), screens_left,
    screens_total, screen_no, field (kept so far and not yet shown) and cut_share of what was shown.

    One row a page is gathered before any window runs."""
    per = paged.groupBy(unit, "page").agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept"))
    w = Window.partitionBy(unit).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(unit)
    total, shown, kept = F.sum("rows").over(whole), F.sum("rows").over(w), F.sum("kept").over(w)
    pages_ = F.count("*").over(whole)
    return per.select(
        unit, "page", (total - shown + F.col("rows")).alias("remaining"), (pages_ - F.col("page")).cast("long").alias("screens_left"), pages_.alias("screens_total"), (F.col("page") + 1).cast("long").alias("screen_no"),
        (kept + total - shown).alias("field"), ((shown - kept) / shown).alias("cut_share"),
    )


def rank_price(n: Column, depth: Column | None = None) -> Column:
    """Comparisons to decide the first ``depth`` places of n: partial or full order, whichever is less, n - 1 at least."""
    d = F.greatest(F.lit(1), F.least(depth if depth is not None else n, n))
    lg = F.log2(n.cast("double"))
    price = F.greatest(n - 1.0, F.least((n - 1) + (d - 1) * lg, n * (lg - 1)))
    return F.when(n < 2, 0).otherwise(F.floor(price + 0.5)).cast("long")


def rank_seconds(comparisons: Column) -> Column:
    return comparisons * SECONDS["comparison"]


def schedule(n: int, target: int | None, page: int = 9, mode: str = "half", custom: int = 1) -> dict | None:
    """Passes with every page's full quota kept, down to HANDOFF times the target; None without a target."""
    if target is None or n < 2:
        return None

    def most(k: int) -> float:
        return {"one": 1, "custom": max(1, min(custom, k)), "unlimited": math.inf}.get(mode, max(1, k // 2))

    pool, passes = n, []
    while pool > HANDOFF * target and len(passes) < MOST_PASSES:
        full, rest = divmod(pool, page)
        after = full * min(page, most(page)) + (min(rest, most(rest)) if rest else 0)
        if after >= pool:
            break
        passes.append((pool, int(after), full + (rest > 0)))
        pool = int(after)
    screens, price = sum(p[2] for p in passes), price_of(pool, min(target, pool))
    return {"passes": passes, "screens": screens, "field": pool, "comparisons": price, "seconds": screens * (SECONDS["page"] + page * SECONDS["row"]) + price * SECONDS["comparison"]}


def price_of(n: int, depth: int) -> int:
    """rank_price() of one field."""
    if n < 2:
        return 0
    d, lg = max(1, min(depth, n)), math.log2(n)
    return math.floor(max(n - 1, min((n - 1) + (d - 1) * lg, n * (lg - 1))) + 0.5)


def schedule_totals(units: DataFrame, page: int = 9) -> DataFrame:
    """unit, n_passes, screens, field, comparisons and seconds of each unit's whole schedule under the half quota."""
    s = schedule_frame(units, page).groupBy("unit").agg(F.count("*").alias("n_passes"), F.sum("screens").alias("screens"), F.min_by("after", -F.col("pass_no")).alias("field"))
    out = units.where("target IS NOT NULL AND n >= 2").join(s, "unit", "left").withColumn("field", F.coalesce("field", "n")).withColumn("screens", F.coalesce("screens", F.lit(0)))
    out = out.withColumn("comparisons", rank_price(F.col("field"), F.least("target", "field")))
    seconds = F.col("screens") * (SECONDS["page"] + page * SECONDS["row"]) + rank_seconds(F.col("comparisons"))
    return out.select("unit", F.coalesce("n_passes", F.lit(0)).alias("n_passes"), "screens", "field", "comparisons", seconds.alias("seconds"))


def schedule_frame(units: DataFrame, page: int = 9) -> DataFrame:
    """unit, pass_no, before, after and screens under the half quota: a native fold over the passes of each unit."""
    kind = "array<struct<pass_no:int,before:bigint,after:bigint,screens:bigint>>"
    start = F.struct(F.col("n").cast("long").alias("pool"), F.array().cast(kind).alias("passes"))

    def step(acc: Column, k: Column) -> Column:
        pool = acc["pool"]
        rest = pool % page
        after = (F.floor(pool / page) * max(1, page // 2) + F.when(rest > 0, F.greatest(F.lit(1), F.floor(rest / 2))).otherwise(0)).cast("long")
        live = (pool > HANDOFF * F.col("target")) & (after < pool)
        one = F.struct(k.cast("int").alias("pass_no"), pool.alias("before"), after.alias("after"), F.ceil(pool / page).cast("long").alias("screens"))
        return F.struct(F.when(live, after).otherwise(pool).alias("pool"), F.when(live, F.concat(acc["passes"], F.array(one))).otherwise(acc["passes"]).cast(kind).alias("passes"))

    folded = units.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.lit(MOST_PASSES)), start, step, lambda acc: acc["passes"]))
    return folded.select("unit", F.explode("p").alias("p")).select("unit", "p.*")


def suggestion(target: Column, pool: Column) -> Column:
    """Whether a unit is small enough to be ranked pair by pair; null without a target."""
    return F.when(target.isNotNull(), pool <= HANDOFF * target)


def toggled(events: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are selected after a log of toggles: those toggled an odd number of times."""
    return events.groupBy(key).agg((F.count("*") % 2 == 1).alias("on")).where("on").select(key)


def undone(events: DataFrame, key: str = "id") -> DataFrame:
    """Toggles that still hold of a log (unit, seq, type: toggle or undo, key): an undo takes back the last toggle not yet taken back.

    Brackets that match: a toggle and the undo that takes it back see the same depth, the one going down as the other went up.
    """
    order = Window.partitionBy("unit").orderBy("seq")
    up = F.when(F.col("type") == "toggle", 1).otherwise(-1)
    # an undo with nothing left does nothing: depth against the least depth so far
    raw = events.withColumn("_raw", F.sum(up).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.min("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    deep = raw.withColumn("_depth", F.col("_raw") - low)
    # a toggle holds if the depth never falls below it again
    after = F.min("_depth").over(order.rowsBetween(1, Window.unboundedFollowing))
    return deep.withColumn("_after", after).where((F.col("type") == "toggle") & (F.col("_after").isNull() | (F.col("_after") >= F.col("_depth")))).select("unit", "seq", key)


def selected(events: DataFrame, key: str = "id") -> DataFrame:
    """unit and key of what is selected after a log of toggles and undos."""
    return undone(events, key).groupBy("unit", key).agg((F.count("*") % 2 == 1).alias("on")).where("on").select("unit", key)


def step_back(paged: DataFrame, kept: DataFrame, page: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Kept rows and the selection after a step back to a page: what was kept there is selected again."""
    here = paged.where(F.col("page") == page)
    return kept.join(here.select(key), key, "left_anti"), kept.join(here.select(key), key, "left_semi")


def rename_face(dealt: DataFrame, old, new, column: str = "face") -> DataFrame:
    return dealt.withColumn(column, F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(F.col(column)))


def pin(reps: DataFrame, groups: DataFrame, face) -> DataFrame:
    """Pinned representatives (unit, id) after a member is pinned: the others of its group are not any more."""
    own = groups.where(F.col("id") == F.lit(face)).select("unit", "group_id")
    members = groups.join(own, ["unit", "group_id"], "left_semi").select("unit", "id")
    return reps.join(members, ["unit", "id"], "left_anti").unionByName(groups.where(F.col("id") == F.lit(face)).select("unit", "id"))


def ranking_of(units: DataFrame) -> DataFrame:
    """unit, depth (places to decide) and cap (places chosen at first; null without limit) of units (unit, entrants, target, rank_depth)."""
    wanted = F.when(F.col("rank_depth").isNotNull(), F.greatest(F.lit(1), F.least("rank_depth", "entrants"))).otherwise(F.least(F.coalesce("target", "entrants"), F.col("entrants")))
    return units.select("unit", wanted.cast("long").alias("depth"), F.when(F.col("target").isNotNull(), F.least("target", "entrants")).cast("long").alias("cap"), F.col("rank_depth").isNotNull().alias("ranks"))


def pending(units: DataFrame) -> DataFrame:
    """Units whose phase is not done."""
    return units.where("phase != 'done'")


def all_done(units: DataFrame) -> DataFrame:
    """One row, done: whether there are units, and all are done."""
    return units.agg((F.count("*") > 0).alias("some"), F.coalesce(F.bool_and(F.col("phase") == "done"), F.lit(False)).alias("every")).select((F.col("some") & F.col("every")).alias("done"))


def eligible(members: DataFrame, rows: DataFrame, final_unit: str = "final") -> DataFrame:
    """id and ord of rows that may be grouped: those of all units but the final one, read without an error, each once where it is first."""
    live = rows.where("err IS NULL").select("id")
    first = members.where(F.col("unit") != final_unit).groupBy("id").agg(F.min(F.struct("unit", "ord")).alias("at"))
    return first.join(live, "id", "left_semi").select("id", F.col("at.unit").alias("unit"), F.col("at.ord").alias("ord"))


def start_pass(spark: SparkSession, pool: DataFrame, groups: DataFrame, seed: int, page: int, shuffle: bool = True) -> DataFrame:
    """A pass' deal: faces in seeded (or pool) order with their pages. The seed is a parameter, so a replay is the same."""
    f = faces(pool, groups).select("unit", "face", F.col("pos").alias("ord")).distinct()
    order = shuffle_rows(f, "unit", "face", seed) if shuffle else f.withColumn("pos", F.row_number().over(Window.partitionBy("unit").orderBy("ord")) - 1).drop("ord")
    return pages(order, "unit", [F.col("pos")], page)
