"""Comparing all members of groups with each other, in tasks of bounded size.

A group of up to ``size`` members is compared in one task. A larger one is dealt into blocks, and
each pair of blocks is a task of its own, so no task holds more than two blocks. Tasks put out sums
for each member and a spanning forest of the links they found, never a row for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowlane.llm._bytes import mix
from winnowlane.llm._scratch import materialize, parts

#: Groups of several blocks that are broadcast, and shares of the rows of one beyond that.
BROADCAST_GROUPS, SALT = 200_000, 16
#: The low bits of a bucket's key are the number of its table or band.
NUMBERS = 255
OUT = "a long, b long, links long"


def units(rows: DataFrame, block: int) -> DataFrame:
    """u1, u2, number, node: nodes that share a bucket, of rows (bucket, node) whose bucket's low bits are its number.

    Each row is sent once. Buckets of one node fall out. A bucket of up to ``block`` nodes becomes a unit named by
    them, so that the same nodes in several buckets are one unit, of the least number; a larger one is named by itself and is
    passed on as it is read, so no bucket is held whole.
    """
    dealt = rows.repartition(parts(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "node")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((2, 0), np.int64)
        held, large = none, None  # rows that may go on in the next batch; the bucket that is being passed on

        def out(rows: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]]) if rows.shape[1] else np.zeros(0, np.int64)
            size = np.diff(np.r_[start, rows.shape[1]])
            h = mix(rows[1].view(np.uint64))
            u1, u2 = (np.add.reduceat(x, start) if len(start) else np.zeros(0, np.uint64) for x in (h, mix(h ^ np.uint64(0x5DEECE66D))))
            bucket = rows[0, start]
            big = (size > block) | ((bucket == large) if large is not None else False)
            u1, u2 = np.where(big, bucket.view(np.uint64), u1).view(np.int64), np.where(big, np.uint64(0), u2 | np.uint64(1)).view(np.int64)
            keep = np.repeat((size > 1) | big, size)
            pick = lambda x: pa.array(np.repeat(x, size)[keep])
            return pa.RecordBatch.from_pydict({"u1": pick(u1), "u2": pick(u2), "number": pick((bucket & NUMBERS).astype(np.int32)), "node": pa.array(rows[1][keep])})

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column("bucket").to_numpy(), batch.column("node").to_numpy()])], axis=1)
            if not rows.shape[1]:
                continue
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            goes_on = rows.shape[1] - last > block or rows[0, -1] == large
            yield out(rows if goes_on else rows[:, :last])
            large, held = (rows[0, -1], none) if goes_on else (None, rows[:, last:])
        yield out(held)

    return dealt.mapInArrow(shared, "u1 long, u2 long, number int, node long").groupBy("u1", "u2", "node").agg(F.min("number").alias("number"))


def first_shared(same: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of pairs with equal codes here and there (pairs, tables), those for which a unit's number is the first."""
    return (same.argmax(axis=1) == number) & same[np.arange(len(number)), number]


def paired(rows: DataFrame, group: str, member: str, size: int, counted: DataFrame | None = None) -> DataFrame:
    """Members with block numbers: each row once for each pair of blocks (i <= j) that its block is in.

    ``counted``: a narrower frame with the same groups and members, from which groups are counted. Only groups of several
    blocks are joined back: broadcast up to BROADCAST_GROUPS of them, and beyond it joined with the rows of one
    group shared among SALT tasks.
    """
    counts = (counted if counted is not None else rows).groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    large = materialize(counts.where("blocks > 1"), "large-groups")
    if large.count() <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(large), group, "left")
    else:
        copies = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(member), F.lit(SALT)).cast("int")).join(copies, [group, "salt"], "left").drop("salt")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    # the pair (i, i) of a group of several blocks is compared once, beside the pairs of two
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def compare(rows: DataFrame, group: str, work: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """work(table, bounds of its groups) over whole groups of (group, i, j); several small ones at once."""
    n = parts(rows.sparkSession)
    keys = [group, "i", "j"]
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for table, bounds in _whole(batches, keys, held):
            yield from work(table, bounds).to_batches()

    return dealt.mapInArrow(run, OUT)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of a sorted table begin, and its length."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.r_[np.flatnonzero(new), n]


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], held: list) -> Iterator[tuple[pa.Table, np.ndarray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        if [held[0].column(k)[0] for k in keys] == last:
            continue
        table = pa.Table.from_batches(held)
        bounds = _bounds(table, keys)
        cut = int(bounds[-2])
        held[:] = table.slice(cut).to_batches()
        yield table.slice(0, cut), bounds[:-1]
    if held:
        table = pa.Table.from_batches(held)
        yield table, _bounds(table, keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) of the graph with edges a - b."""
    nodes, number = np.unique(np.r_[a, b], return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    hang = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hang], nodes[label[hang]]


def rows(ids: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """OUT rows of the links between row numbers a and b: sums for each member, and a forest."""
    total = np.bincount(a, weights=weights[b], minlength=len(ids)) + np.bincount(b, weights=weights[a], minlength=len(ids))
    some = np.flatnonzero(total)
    x, y = forest(ids[a], ids[b]) if len(a) else (np.zeros(0, np.int64),) * 2
    return pa.table({
        "a": pa.array(np.r_[ids[some], x], pa.int64()), "b": pa.array(np.r_[np.zeros(len(some), np.int64), y], pa.int64(), mask=np.r_[np.ones(len(some), bool), np.zeros(len(x), bool)]),
        "links": pa.array(np.r_[total[some].astype(np.int64), np.zeros(len(x), np.int64)], pa.int64()),
    })


def pairs_within(bounds: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of each group, some at a time; in a pair of two blocks only across them."""
    from winnowlane.llm._bytes import ragged

    n = int(bounds[-1])
    end = np.repeat(bounds[1:], np.diff(bounds))
    lens = end - 1 - np.arange(n)
    upto = np.cumsum(lens)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")))
        here = np.arange(at, to)
        a, b = np.repeat(here, lens[at:to]), ragged(here + 1, lens[at:to])
        across = (i[a] == j[a]) | (own[a] != own[b])
        yield a[across], b[across]
        at = to
