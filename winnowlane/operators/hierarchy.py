"""Folder trees from paths, counts rolled up, and quotas handed down.

Depth is no loop: every row is counted under each prefix of its path, and questions about ancestors
or descendants are equi-joins on exploded prefixes.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowlane.operators.order import arrow_schema, none
from winnowlane.scratch import materialize

LOOSE = "__loose__"
#: Folders whose quotas are resolved in one place, and that are broadcast to rows.
BROADCAST_FOLDERS = 200_000


def prefixes(path: Column) -> Column:
    """All prefixes of a path, the root ('') and itself included."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def parent_of(path: Column) -> Column:
    """The folder above; null above the root."""
    return F.when(path == "", F.lit(None).cast("string")).when(~path.contains("/"), F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def depth_of(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def tree(rows: DataFrame, folder: str = "dir") -> tuple[DataFrame, DataFrame]:
    """Nodes of the tree, and rows with the node that holds each (column ``node``).

    Every ancestor is a node. Rows directly in a folder that has folders below move to a synthetic
    child. A null folder is the root. Nodes: path, parent_path, depth, own_count, synthetic. Rows are counted by folder
    once; all else is about folders.
    """
    clean = F.array_join(F.filter(F.split(F.coalesce(F.col(folder), F.lit("")), "/"), lambda p: p != ""), "/")
    direct = rows.groupBy(clean.alias("path")).agg(F.count("*").alias("n"))
    root = rows.sparkSession.range(1).select(F.lit("").alias("path"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("below"))
    # each folder with how far below it rows lie: of a prefix, some; of the folder itself, none
    steps = direct.select("path", "n", F.posexplode(F.reverse(prefixes(F.col("path")))).alias("up", "at"))
    seen = steps.select(F.col("at").alias("path"), F.when(F.col("up") == 0, F.col("n")).otherwise(0).cast("long").alias("n"), F.when(F.col("up") > 0, 1).otherwise(0).alias("below")).unionByName(root)
    every = seen.groupBy("path").agg(F.sum("n").alias("own_count"), (F.max("below") == 1).alias("inner"))
    child = F.when(F.col("path") == "", F.lit(LOOSE)).otherwise(F.concat("path", F.lit(f"/{LOOSE}")))
    loose = F.col("inner") & (F.col("own_count") > 0)
    own = F.struct(F.col("path").alias("path"), F.when(loose, F.lit(0).cast("long")).otherwise(F.col("own_count")).alias("own_count"), F.lit(False).alias("synthetic"))
    both = F.when(loose, F.array(own, F.struct(child.alias("path"), F.col("own_count").alias("own_count"), F.lit(True).alias("synthetic")))).otherwise(F.array(own))
    every = materialize(every.select("path", loose.alias("_moves"), F.explode(both).alias("x")), "tree")
    nodes = every.select("x.path", parent_of(F.col("x.path")).alias("parent_path"), depth_of(F.col("x.path")).alias("depth"), "x.own_count", "x.synthetic")
    moves = every.where("_moves AND x.synthetic").select(F.col("path").alias("node"), F.col("x.path").alias("_to"))
    placed = rows.withColumn("node", clean)
    few_moves = F.broadcast(moves) if moves.count() <= BROADCAST_FOLDERS else moves
    held = placed.join(few_moves, "node", "left").withColumn("node", F.coalesce("_to", "node")).drop("_to")
    return nodes, held


def rollup_counts(rows: DataFrame, folder: str = "dir") -> DataFrame:
    """path and n: rows in each folder and all below it."""
    direct = rows.groupBy(F.coalesce(F.col(folder), F.lit("")).alias("p")).agg(F.count("*").alias("n"))
    return direct.select(F.explode(prefixes(F.col("p"))).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n"))


def parse_quota(raw: Column) -> Column:
    """Struct mode, value of a quota as typed.

    Blank: pooled. ``*``, infinity or ``inf``: uncapped. A percentage from 0 to 100: percent, none of it excluded.
    Digits: fixed, 0 excluded. Anything else: invalid.
    """
    x = F.trim(F.coalesce(raw, F.lit("")))
    share = F.nullif(F.regexp_extract(x, r"^([0-9]{0,3}(?:\.[0-9]+)?)\s*%$", 1), F.lit("")).cast("double")
    count = F.nullif(F.regexp_extract(x, r"^([0-9]+)$", 1), F.lit("")).cast("double")
    mode = (
        F.when(x == "", "pooled").when(x.isin("*", "∞") | (F.lower(x) == "inf"), "uncapped").when(share == 0, "excluded")
        .when(share <= 100, "percent").when(count == 0, "excluded").when(count > 0, "fixed").otherwise("invalid")
    )
    return F.struct(mode.alias("mode"), F.when(mode == "percent", share).when(mode == "fixed", count).alias("value"))


def quota_text(mode: Column, value: Column) -> Column:
    """What parse_quota() reads back."""
    number = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.when(mode == "uncapped", "*").when(mode == "excluded", "0").when(mode == "percent", F.concat(number, F.lit("%"))).when(mode == "fixed", number).otherwise("")


def percent_count(percent: Column, n: Column) -> Column:
    """Rows that a percentage of n comes to: halves up, at least one of any, none of none."""
    return F.when((n > 0) & (percent > 0), F.greatest(F.lit(1), F.least(n, F.floor(percent / 100.0 * n + 0.5)))).otherwise(0).cast("long")


def shortest_percent(count: Column, n: Column, digits: int = 6) -> Column:
    """The percentage with fewest decimals that comes to the count again; null if none does."""
    tries = F.array(*[F.round(100.0 * count / n, d) for d in range(digits + 1)])
    return F.when((n > 0) & (count > 0), F.get(F.filter(tries, lambda p: percent_count(p, n) == count), F.lit(0)))


def resolve(nodes: DataFrame, quotas: DataFrame, few_folders: int = BROADCAST_FOLDERS) -> DataFrame:
    """Nodes with their quota: mode, value, excluded, subtree_count, eff_mode, eff_value, is_leaf, target, kids' sums.

    ``quotas``: path and raw text; nodes without one are pooled. Subtree counts leave excluded folders
    out; percentages are of the folder's own subtree.
    """
    asked = quotas.select("path", parse_quota(F.col("raw")).alias("q")).select("path", "q.*")
    n = nodes.select("path", "parent_path", "depth", "own_count", "synthetic").join(asked, "path", "left").withColumn("mode", F.coalesce("mode", F.lit("pooled")))
    # up to BROADCAST_FOLDERS of them one task works them out in one pass up and one down; beyond, each step is a join, dealt and written
    if nodes.count() <= few_folders:
        return materialize(n.coalesce(1).mapInArrow(_resolved_at_once(arrow_schema(_RESOLVED)), _RESOLVED), "nodes")
    keep = lambda f: materialize(f, "nodes")
    n = keep(n)
    up = n.select("path", "own_count", F.explode(prefixes(F.col("path"))).alias("above"))
    shut = n.where("mode = 'excluded'").select(F.col("path").alias("above"), F.lit(True).alias("shut"))
    closed = up.join(shut, "above").select("path").distinct().withColumn("excluded", F.lit(True))
    n = keep(n.join(closed, "path", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False))))
    live = n.where("NOT excluded").select("path", "own_count", F.explode(prefixes(F.col("path"))).alias("above"))
    totals = live.groupBy(F.col("above").alias("path")).agg(F.sum("own_count").alias("subtree_count"))
    n = n.join(totals, "path", "left").withColumn("subtree_count", F.when(F.col("excluded"), 0).otherwise(F.coalesce("subtree_count", F.lit(0))))
    is_percent = F.col("mode") == "percent"
    n = n.withColumn("eff_mode", F.when(is_percent, "fixed").otherwise(F.col("mode"))).withColumn("eff_value", F.when(is_percent, percent_count(F.col("value"), F.col("subtree_count"))).otherwise(F.col("value")).cast("long"))
    kids = n.where("NOT excluded AND parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("kids"))
    n = keep(n.join(kids, "path", "left").withColumn("is_leaf", F.col("kids").isNull()))
    fixed = F.col("eff_mode") == "fixed"
    target = F.when(F.col("excluded"), F.lit(0)).when(fixed & F.col("is_leaf"), F.least("eff_value", "subtree_count")).when(fixed, F.col("eff_value")).cast("long")
    n = n.withColumn("target", target)
    asked_below = n.where("NOT excluded AND eff_mode IN ('fixed', 'uncapped')").select(F.col("path").alias("low"), F.explode(prefixes(F.col("path"))).alias("path")).where("low != path")
    busy = asked_below.select("path").distinct().withColumn("has_quota_below", F.lit(True))
    n = n.join(busy, "path", "left").withColumn("has_quota_below", F.coalesce("has_quota_below", F.lit(False)))
    mode = lambda m: F.col("eff_mode") == m
    sums = n.where("NOT excluded AND parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(
        F.sum(F.when(mode("fixed"), F.coalesce("target", F.lit(0))).otherwise(0)).alias("fixed_sum"), F.count_if(mode("uncapped")).alias("uncapped_kids"),
        F.count_if(mode("pooled")).alias("pooled_kids"), F.sum(F.when(mode("pooled"), F.col("subtree_count")).otherwise(0)).alias("pool_count"),
    )
    n = n.join(sums, "path", "left")
    splits = ~F.col("excluded") & ~F.col("is_leaf") & mode("fixed") & (F.col("fixed_sum") <= F.col("eff_value"))
    out = n.withColumn("remainder", F.when(splits, F.col("eff_value") - F.col("fixed_sum"))).withColumn("share", F.when(F.col("remainder").isNotNull(), F.least("remainder", "pool_count")))
    return materialize(out, "nodes")


_RESOLVED = "path string, parent_path string, depth int, own_count long, synthetic boolean, mode string, value double, excluded boolean, subtree_count long, eff_mode string, eff_value long, kids long, is_leaf boolean, target long, has_quota_below boolean, fixed_sum long, uncapped_kids long, pooled_kids long, pool_count long, remainder long, share long"


def _resolved_at_once(kinds: pa.Schema):
    """resolve() of all folders of one partition."""

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: r["depth"])
        at = {r["path"]: r for r in rows}
        for r in rows:  # downward
            above = at.get(r["parent_path"]) if r["parent_path"] is not None else None
            r |= {"above": above, "excluded": r["mode"] == "excluded" or bool(above and above["excluded"]), "subtree_count": 0, "kids": None, "has_quota_below": False, "fixed_sum": None, "uncapped_kids": None, "pooled_kids": None, "pool_count": None}
        for r in reversed(rows):  # upward: what is below a folder is known before it
            above, n = r["above"], r["subtree_count"] + r["own_count"]
            n = r["subtree_count"] = 0 if r["excluded"] else n
            percent = r["mode"] == "percent"
            r["eff_mode"] = mode = "fixed" if percent else r["mode"]
            share = max(1, min(n, math.floor(r["value"] / 100.0 * n + 0.5))) if percent and n > 0 and r["value"] > 0 else 0
            r["eff_value"] = share if percent else None if r["value"] is None else int(r["value"])
            r["is_leaf"] = r["kids"] is None
            fixed = mode == "fixed"
            r["target"] = 0 if r["excluded"] else None if not fixed else min(r["eff_value"], n) if r["is_leaf"] else r["eff_value"]
            splits = not r["excluded"] and not r["is_leaf"] and fixed and r["fixed_sum"] <= r["eff_value"]
            r["remainder"] = r["eff_value"] - r["fixed_sum"] if splits else None
            r["share"] = min(r["remainder"], r["pool_count"]) if splits else None
            if above and not r["excluded"]:
                above["subtree_count"] += n
                above["has_quota_below"] |= r["has_quota_below"] or mode in ("fixed", "uncapped")
                for c in ("kids", "fixed_sum", "uncapped_kids", "pooled_kids", "pool_count"):
                    above[c] = above[c] or 0
                above["kids"] += 1
                above["fixed_sum"] += (r["target"] or 0) if fixed else 0
                above["uncapped_kids"] += mode == "uncapped"
                above["pooled_kids"] += mode == "pooled"
                above["pool_count"] += n if mode == "pooled" else 0
        for r in rows:
            r.pop("above")
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return run


def units(resolved: DataFrame) -> DataFrame:
    """unit_id, kind, owner_path and target (null: no limit) of each set of rows that competes for places."""
    leaf = resolved.where("NOT excluded AND is_leaf AND subtree_count > 0")
    free = leaf.where("eff_mode = 'uncapped'").select(F.lit("uncapped").alias("kind"), "path", F.lit(None).cast("long").alias("target"))
    fixed = leaf.where("eff_mode = 'fixed' AND target > 0").select(F.lit("fixed").alias("kind"), "path", "target")
    pooled = resolved.where("share > 0 AND pooled_kids > 0").select(F.lit("pooled").alias("kind"), "path", F.col("share").alias("target"))
    every = free.unionByName(fixed).unionByName(pooled)
    owner = F.when(F.col("path") == "", F.lit("root")).otherwise(F.col("path"))
    return every.select(F.concat_ws(":", "kind", owner).alias("unit_id"), "kind", F.col("path").alias("owner_path"), "target")


def unit_paths(resolved: DataFrame, found: DataFrame) -> DataFrame:
    """unit_id and the member folders of each unit."""
    own = found.where("kind != 'pooled'").select("unit_id", F.col("owner_path").alias("path"))
    kids = resolved.where("NOT excluded AND eff_mode = 'pooled'").select("path", F.col("parent_path").alias("owner_path"))
    return own.unionByName(found.where("kind = 'pooled'").join(kids, "owner_path").select("unit_id", "path"))


def members(held: DataFrame, resolved: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """unit_id and row key: rows at or below a unit's folders that no excluded folder holds.

    As a pooled folder hands over all its rows, a row may be in two units.
    """
    live = resolved.where("NOT excluded").select(F.col("path").alias("node"))
    # units are matched with folders first, which are few; rows then meet only the folder that holds them
    owned = live.select("node", F.explode(prefixes(F.col("node"))).alias("path")).join(unit_paths(resolved, found), "path").select("node", "unit_id")
    return few(held, owned, "node").select("unit_id", key)


def few(rows: DataFrame, folders: DataFrame, on: str) -> DataFrame:
    """Join rows with folders: broadcast up to BROADCAST_FOLDERS of them, shuffled beyond."""
    return rows.join(F.broadcast(folders) if folders.count() <= BROADCAST_FOLDERS else folders, on)


def issues(resolved: DataFrame, found: DataFrame) -> DataFrame:
    """path, level and code of what is wrong or odd about the quotas."""
    r = resolved.where("NOT excluded")

    def flag(rows: DataFrame, level: str, code: str) -> DataFrame:
        return rows.select("path", F.lit(level).alias("level"), F.lit(code).alias("code"))

    inner, fixed = r.where("NOT is_leaf"), r.where("NOT is_leaf AND eff_mode = 'fixed'")
    settled = fixed.where("remainder IS NOT NULL")
    parents = r.select(F.col("path").alias("parent_path"), F.col("eff_mode").alias("parent_mode"), F.col("share").alias("parent_share"))
    pooled = r.where("eff_mode = 'pooled'").select("path", "parent_path", "has_quota_below").join(parents, "parent_path")
    out = flag(r.where("is_leaf AND eff_mode = 'fixed' AND eff_value > subtree_count"), "warn", "clamped")
    out = out.unionByName(flag(pooled.where("parent_mode = 'uncapped' AND NOT has_quota_below"), "error", "dead-pool"))
    out = out.unionByName(flag(fixed.where("remainder IS NULL"), "error", "oversubscribed"))
    out = out.unionByName(flag(settled.where("uncapped_kids > 0"), "error", "uncapped-under-fixed"))
    out = out.unionByName(flag(settled.where("pooled_kids > 0 AND remainder > pool_count"), "warn", "pool-clamped"))
    out = out.unionByName(flag(pooled.where("parent_mode = 'fixed' AND parent_share = 0"), "warn", "no-remainder"))
    out = out.unionByName(flag(settled.where("pooled_kids = 0 AND remainder > 0"), "note", "unused-remainder"))
    none = found.agg(F.count("*").alias("n_units"))
    bare = r.where("path = '' AND eff_mode = 'pooled' AND subtree_count > 0").crossJoin(F.broadcast(none)).where("n_units = 0")
    return out.unionByName(flag(bare, "note", "root-unallocated"))


def severity(level: Column) -> Column:
    return F.when(level == "error", 0).when(level == "warn", 1).otherwise(2)


def projected_total(found: DataFrame) -> DataFrame:
    """Places of all units together; null if one has no limit."""
    return found.agg(F.when(F.coalesce(F.bool_or(F.col("target").isNull()), F.lit(False)), F.lit(None).cast("long")).otherwise(F.coalesce(F.sum("target"), F.lit(0))).alias("projected_total"))


def apply_to_all(nodes: DataFrame, raw: str) -> DataFrame:
    """The same quota for every folder that holds rows."""
    return nodes.where("own_count > 0").select("path", F.lit(raw).alias("raw"))


def rank_flag(found: DataFrame, paths: DataFrame, flagged: DataFrame) -> DataFrame:
    """Units with whether their folder, or one of their folders, is flagged."""
    hit = paths.unionByName(found.select("unit_id", F.col("owner_path").alias("path"))).join(flagged, "path", "left_semi").select("unit_id").distinct().withColumn("ranked", F.lit(True))
    return found.join(hit, "unit_id", "left").withColumn("ranked", F.coalesce("ranked", F.lit(False)))


def start_units(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Units that exist stay as they are; new ones join them."""
    return existing.unionByName(found.join(existing.select("unit_id"), "unit_id", "left_anti"), allowMissingColumns=True)


def apportion(kids: DataFrame, total: int | str, even: bool = False) -> DataFrame:
    """path and places: a total (or the column that has each parent's) shared among folders by largest remainders, none above its rows.

    What a full folder can't take goes to the others one by one in order. ``kids``: parent_path, path, ord, subtree_count.
    Folders of one parent are handled together; there are as many as a folder has children.
    """

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.subtree_count > 0].sort_values("ord", kind="stable").reset_index(drop=True)
        if not len(pdf):
            return none(schema)
        places = int(pdf[total].iloc[0]) if isinstance(total, str) else total
        caps = pdf.subtree_count.to_numpy()
        weight = caps * 0 + 1 if even else caps
        exact = places * weight / max(weight.sum(), 1)
        got = exact.astype("int64")
        order = pd.Series(exact - got).sort_values(ascending=False, kind="stable").index[: max(0, places - int(got.sum()))]
        got[order] += 1
        spare = int((got - caps).clip(min=0).sum())
        got = got.clip(max=caps)
        while spare and (got < caps).any():
            open_ = (got < caps).nonzero()[0]
            # whole rounds at once, then one each in order
            rounds = min(spare // len(open_), int((caps - got)[open_].min()))
            chosen = open_ if rounds else open_[:spare]
            got[chosen] += max(rounds, 1)
            spare -= len(chosen) * max(rounds, 1)
        return pd.DataFrame({"path": pdf.path, "places": got})

    schema = "path string, places long"
    return kids.groupBy("parent_path").applyInPandas(share, schema)


def sibling_order(nodes: DataFrame) -> DataFrame:
    """Nodes with ``ord`` among their siblings: natural order, synthetic ones last."""
    from winnowlane.functions.text import natural_key

    return nodes.withColumn("ord", F.row_number().over(Window.partitionBy("parent_path").orderBy("synthetic", natural_key(F.col("path")), "path")))


def apply_shares(quotas: DataFrame, shares: DataFrame) -> DataFrame:
    """Quotas (path, raw) with apportioned places (path, places) written in place of what those folders had."""
    return quotas.join(shares.select("path"), "path", "left_anti").unionByName(shares.select("path", F.col("places").cast("string").alias("raw")))


def outside(rows: DataFrame, excluded: DataFrame, folder: str = "dir") -> DataFrame:
    """Rows that lie in no excluded folder nor below one."""
    at = rows.select(F.coalesce(F.col(folder), F.lit("")).alias("_f")).distinct().withColumn("path", F.explode(prefixes(F.col("_f"))))
    bad = at.join(excluded.select("path"), "path", "left_semi").select("_f").distinct()
    return rows.withColumn("_f", F.coalesce(F.col(folder), F.lit(""))).join(bad, "_f", "left_anti").drop("_f")
