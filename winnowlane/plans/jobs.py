"""Whole jobs composed from operators: cull to finalists, sort and tag, replay a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowlane.operators import hierarchy, organize, ranking, results, similarity, staged, tags


def cull(rows: DataFrame, quotas: DataFrame, threshold: int = 14, page: int = 9, seed: int = 1) -> dict[str, DataFrame]:
    """From rows (id, dir, hi, lo, sharp, pixels, score) to ranked finalists of each unit.

    Quotas make units; near-duplicates of a unit stand behind their representative; one pass keeps the better half of
    every page; what is left is ranked and cut at the unit's target.
    """
    nodes, held = hierarchy.tree(rows)
    resolved = hierarchy.resolve(nodes, quotas)
    found = hierarchy.units(resolved)
    member = hierarchy.members(held, resolved, found).withColumnRenamed("unit_id", "unit").join(rows, "id")
    groups = similarity.cluster(member, threshold)
    best = similarity.representatives(groups.join(member.select("unit", "id", "sharp", "pixels", "score"), ["unit", "id"]), ["unit", "group_id"])
    paged = staged.pages(staged.spread(best.select("unit", "id", "score"), "unit", "id", seed), "unit", [F.col("pos")], page)
    kept = staged.keep_per_page(paged, "unit", [F.col("score").desc(), F.col("id")])
    ranked = ranking.top_k(kept.where("kept"), "unit", [F.col("score").desc(), F.col("id")], None)
    finalists = ranked.join(found.select(F.col("unit_id").alias("unit"), "target"), "unit").where("target IS NULL OR place <= target")
    return {"issues": hierarchy.issues(resolved, found), "units": found, "groups": groups, "finalists": finalists.select("unit", "id", "place")}


def sort_and_tag(rows: DataFrame, categories: dict[str, Column], names: DataFrame, marks: DataFrame) -> DataFrame:
    """The manifest of all rows, each in the folder of its group, with its tags. Nothing is left out but rows with an error."""
    live = rows.where("err IS NULL") if "err" in rows.columns else rows
    grouped = organize.assign_groups(live, categories, "folder")
    return results.manifest(grouped, tags.tag_list(marks, names))


def default_categories(rows: DataFrame, when: str = "taken") -> list[str]:
    """By day if at least half of the rows say when they were made, else by folder."""
    n = rows.agg(F.count_if(F.col(when).isNotNull()).alias("known"), F.count("*").alias("n")).head()
    return ["day"] if n.n and 2 * n.known >= n.n else ["folder"]
