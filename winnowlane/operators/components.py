"""Connected components of a graph given as a frame of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowlane.scratch import materialize


#: Shares of the edges of one node, joined apart.
SALT = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least around u; those of a node with very many are no single task's load."""
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(copies, ["u", "salt"]).drop("salt")


def _star(edges: DataFrame) -> DataFrame:
    """Hang each node's smaller neighbours, and itself, on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = _with_least(edges, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its least node) of every node that an edge (a, b) names; nodes of any ordered type.

    Large and small stars alternate until the graph is a forest of stars. Least neighbours are
    taken by map-side aggregation, so a node with very many neighbours is no single task's load;
    each round is cut off by a table in the shared folder. Only counts reach the driver.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(both, "edges")
    for _ in range(rounds):
        # a forest of stars: each node hangs on one other, and none of those hangs on a third
        ends = now.groupBy("u").agg(F.count("*").alias("n"))
        if not ends.where("n > 1").limit(1).count() and not now.select("v").join(ends.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: neighbours larger than the node hang on the least around it
        large = _with_least(around.where("v > u"), least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = materialize(_star(large).distinct(), "edges")
    raise RuntimeError(f"no forest of stars after {rounds} rounds")
