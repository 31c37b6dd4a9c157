"""Mixing sources to target weights with hash-threshold histograms.

Tokens are summed by source and hash bucket; running sums over the buckets show where a source's
budget is crossed; only that boundary bucket is looked at again, by the next bits of the hash.
What remains is one threshold for each source, and a filter. Nothing is sorted but histograms.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowlane.llm._scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that each of the LEVELS looks at.
BITS, LEVELS = 14, 3
#: Thresholds are broadcast only up to so many sources; beyond it the join on the source is salted.
BROADCAST_SOURCES, SALT = 20_000, 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, in the order of code points, a null source last."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("2"))


def position(*ids: Column, seed: int = 17) -> Column:
    """A document's place in [0, 2**(BITS * LEVELS)), the same on every run."""
    return F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << (BITS * LEVELS)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to one row a source (skey, source_size).

    Sources in the order of skey weigh ``weights``, repeating, and share ``share`` of all sizes by
    weight. No target is above ``cap`` times its source's size; the excess is shared anew. That
    ends at min(cap * size, rate * weight) with one rate for all: sources by falling need of a
    rate, the first whose cap the rate left for it does not reach gives the rate. Sources without
    words have the target 0.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy("skey"))
    out = sizes.withColumn("weight", F.get(cycle, ((rank - 1) % len(weights)).cast("int")))
    out = out.withColumn("most", F.col("source_size") * float(cap)).withColumn("need", F.col("most") / F.col("weight"))
    order = Window.orderBy("need", "skey")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    out = out.withColumn("rate", (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rate = F.coalesce(F.max(F.when(F.col("rate") <= F.col("need"), F.col("rate"))).over(everything), F.min("rate").over(everything))
    return out.withColumn("target", F.greatest(F.lit(0.0), F.least(F.col("most"), rate * F.col("weight")))).select("skey", "source_size", "target")


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row a source: every document ``whole`` times, and once more where its place is below ``cut``
    (or at it, if ``at_cut``)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = wanted.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    keep = ["skey", "source_size", "target", "whole"]
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        here = sized.withColumn("bin", F.shiftright("place", shift))
        # map-side sums first: a source's histogram has at most 2**BITS rows, however many documents it has
        if level:
            edge = state.select("skey", "prefix")
            here = _with_sources(here, edge, state).where(F.shiftright("bin", BITS) == F.col("prefix"))
        bins = here.groupBy("skey", "bin").agg(F.sum("size").alias("tokens"))
        run = F.sum("tokens").over(Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        crossed = (
            bins.withColumn("upto", run)
            .join(state.select("skey", "left"), "skey")
            .where(F.col("upto") > F.col("left"))
            .groupBy("skey")
            .agg(F.min_by(F.struct("bin", "tokens", (F.col("left") - (F.col("upto") - F.col("tokens"))).alias("left")), "bin").alias("edge"))
        )
        state = state.drop("left", "prefix", "tokens").join(crossed, "skey", "left").select(*keep, F.coalesce("edge.left", F.lit(0.0)).alias("left"), F.coalesce("edge.bin", F.lit(1 << (BITS * (level + 1)))).alias("prefix"), F.coalesce("edge.tokens", F.lit(0)).alias("tokens"))
        state = materialize(state, "mix-edge")
    some = F.col("target") > F.col("whole") * F.col("source_size")
    return state.select(*keep, F.when(some, F.col("prefix")).otherwise(0).alias("cut"), (some & (F.col("tokens") > 0) & (2 * F.col("left") >= F.col("tokens"))).alias("at_cut"))


def _with_sources(rows: DataFrame, by_source: DataFrame, counted: DataFrame) -> DataFrame:
    """Join rows with one row a source, without gathering a large source in one task."""
    if counted.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(by_source), "skey")
    salted = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.col("place"), F.lit(SALT)).cast("int")).join(salted, ["skey", "salt"]).drop("salt")


def _limits(sized: DataFrame, **shares) -> DataFrame:
    sizes = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    return thresholds(sized, materialize(targets(sizes, **shares), "mix-targets"))


def _times() -> Column:
    more = (F.col("place") < F.col("cut")) | ((F.col("place") == F.col("cut")) & F.col("at_cut"))
    return F.col("whole") + F.when(more, 1).otherwise(0)


def plan(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",), source: str = "source", text: str = "text", seed: int = 17, **shares) -> DataFrame:
    """The mix's decision for each document: doc_id, size, source_size, target, taken.

    A null text has the size 0; a null source is a source of its own, last in order. Rows that
    repeat an id share a place and are taken together. Every document is taken 0, 1 or 2 times
    (at most ``cap``, rounded up); an empty table gives no rows.
    """
    sized = docs.select(F.col(ids[0]).alias("doc_id"), word_count(F.col(text)).alias("size"), source_key(F.col(source)).alias("skey"), position(*map(F.col, ids), seed=seed).alias("place"))
    sized = materialize(sized, "mix-sized")
    limits = _limits(sized, **shares)
    return _with_sources(sized, limits, limits).select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mix(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",), source: str = "source", text: str = "text", seed: int = 17, **shares) -> DataFrame:
    """The mixed documents: all columns of docs, each row as often as the mix takes it."""
    here = {"skey": source_key(F.col(source)), "place": position(*map(F.col, ids), seed=seed)}
    sized = materialize(docs.select(word_count(F.col(text)).alias("size"), here["skey"].alias("skey"), here["place"].alias("place")), "mix-sized")
    limits = _limits(sized, **shares)
    row = docs.select(F.struct(*docs.columns).alias("row"), here["skey"].alias("skey"), here["place"].alias("place"))
    taken = _with_sources(row, limits, limits).withColumn("times", _times()).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
