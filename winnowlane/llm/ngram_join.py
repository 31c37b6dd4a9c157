"""N-gram Jaccard join with MinHash banding.

Five-word shingles; bands and rows for the wanted recall at the threshold; bands meet by their
hashes, and pairs that share a band are verified on their full sets of shingles. Documents that meet directly or through
others are gathered, as that sends each set once; where chance has chained more than WHOLE of them, sets are sent by
band, and a pair is verified in the first band it shares. Either way the same pairs are linked: those that share a band and are
alike. Documents with equal sets are compared once and counted as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnowlane.llm import _blocks
from winnowlane.llm import _bytes as B
from winnowlane.llm._components import components
from winnowlane.llm._scratch import materialize
from winnowlane.llm.bpe import text_batches

WORDS, JACCARD = 5, 0.8
#: Rows of a band, and the share of pairs at the threshold itself that may be missed.
ROWS, MISS = 5, 1e-5
BLOCK = 512
#: Documents gathered through others that are sent together; from there on bands send fewer copies of a set than blocks.
WHOLE = 7_000
#: Shingles compared at once, as columns of a 0-1 matrix, and pairs whose bands are compared at once.
SLAB, PAIRS = 8192, 32_768
U = np.uint64


def bands_for(jaccard: float = JACCARD, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the threshold shares at least one with probability 1 - miss."""
    return math.ceil(math.log(miss) / math.log(1 - jaccard**rows)) if jaccard < 1 else 1


def shingle_sets(column, width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` are one shingle, no words none."""
    data, offsets = B.text_buffer(column)
    starts, ends, first = B.word_bounds(data, offsets)
    words = B.FIRST.words(data, starts, ends)
    grams = B.FIRST.windows(words, width)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(B.FIRST.windows(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    k1 = np.array([B.mix(s).sum(dtype=U) + U(len(s)) for s in sets], U)
    k2 = np.array([B.mix(s ^ U(0x5DEECE66D)).sum(dtype=U) for s in sets], U)
    return k1.view(np.int64), k2.view(np.int64)


def signatures(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> np.ndarray:
    """Band hashes (sets, bands); sets must not be empty."""
    every = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), bands), U)
    odd = B.stream(0x3A5D, bands * rows) | U(1)
    for band in range(bands):
        acc = np.full(len(sets), band + 1, U)
        for r in range(rows):
            acc = B.mix(acc * U(0x9E3779B97F4A7C15) + (np.minimum.reduceat(every * odd[band * rows + r], at) >> U(24)))
        out[:, band] = acc
    return out


def _classed(docs: DataFrame, jaccard: float = JACCARD, width: int = WORDS, miss: float = MISS, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """doc_id, print (a hash of the text), node (of the row's class), class_id and n_links of each row."""
    bands = bands_for(jaccard, ROWS, miss)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            some = [i for i, s in enumerate(sets) if len(s)]
            k1, k2 = _set_keys(sets)
            codes: list = [None] * len(sets)
            if some:
                for i, c in zip(some, signatures([sets[i] for i in some], bands).view(np.int64)):
                    codes[i] = c.tolist()
            none = np.array([c is None for c in codes])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "print": batch.column("print"), "k1": pa.array(k1, mask=none), "k2": pa.array(k2, mask=none), "codes": pa.array(codes, pa.list_(pa.int64()))})

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(plain.withColumn("print", F.xxhash64("text")).mapInArrow(sketch, "doc_id long, print long, k1 long, k2 long, codes array<long>"), "sketches")
    sound = base.where("k1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(sound.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("codes").alias("codes")).withColumn("node", F.monotonically_increasing_id()), "classes")
    # nodes are classes of equal sets, not ids: two texts under one id are two nodes
    held = classes.select(F.col("node").alias("rep"), F.explode("codes").alias("band"))
    hubs = held.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1").select("band", "hub")
    met = held.join(hubs, "band").where("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    near = components(met)
    near = materialize(near, "met")
    chained = materialize(near.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > whole).select("component"), "chained")
    n_chained = chained.count()
    chained = F.broadcast(chained) if n_chained <= _blocks.BROADCAST_GROUPS else chained
    apart = near.join(chained, "component", "left_anti") if n_chained else near
    grouped_as = apart.select("node", F.col("component").alias("unit"), F.lit(0).cast("long").alias("u2"), F.lit(-1).alias("number"))
    if n_chained:
        rows = near.join(chained, "component", "left_semi").join(classes.select("node", "codes"), "node").select("node", F.posexplode("codes").alias("band", "code"))
        keys = rows.select(F.col("code").bitwiseAND(F.lit(~_blocks.NUMBERS)).bitwiseOR(F.col("band")).alias("bucket"), "node")
        grouped_as = grouped_as.unionByName(_blocks.units(keys, block).withColumnRenamed("u1", "unit"))
    members = materialize(grouped_as.join(classes.select("node", F.col("rep").alias("doc_id"), "n", "k1", "k2", "codes"), "node").select("node", "unit", "u2", "number", "doc_id", "n", "k1", "k2", "codes"), "members")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            k1, k2 = _set_keys(sets)
            # of rows that repeat an id, the one whose set is meant
            right = np.flatnonzero((k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy()))
            keep = batch.select(["node", "unit", "u2", "number", "n", "codes"]).take(pa.array(right))
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array([sets[i].tobytes() for i in right], pa.binary())], [*keep.schema.names, "shingles"])

    texts = plain.join(members, "doc_id").mapInArrow(gather, "node long, unit long, u2 long, number int, n long, codes array<long>, shingles binary")

    def work(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        ids, n = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.float64)
        own, i, j, number, u2 = (table.column(c).to_numpy() for c in ("own", "i", "j", "number", "u2"))
        codes = table.column("codes").combine_chunks()
        packed = table.column("shingles").to_pylist()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for x, y in zip(bounds[:-1], bounds[1:]):
            # rows that repeat an id and a text appear once
            _, here = np.unique(np.stack([ids[x:y], u2[x:y], number[x:y]]), axis=1, return_index=True)
            here = np.sort(here) + x
            a, b = _similar([np.frombuffer(packed[r], U) for r in here], jaccard)
            a, b = here[a], here[b]
            ok = ((i[a] == j[a]) | (own[a] != own[b])) & (number[a] == number[b]) & (u2[a] == u2[b])
            a, b = a[ok], b[ok]
            if len(a):
                some, at = np.unique(np.r_[a, b], return_inverse=True)
                code = codes.take(pa.array(some)).flatten().to_numpy().reshape(len(some), bands) & ~_blocks.NUMBERS
                keep = np.zeros(len(a), bool)
                for low in range(0, len(a), PAIRS):
                    here = slice(low, low + PAIRS)
                    same = code[at[: len(a)][here]] == code[at[len(a) :][here]]
                    # pairs that met; in a unit of one band, of those that share several the ones whose first band it is
                    keep[here] = _blocks.first_shared(same, number[a[here]]) if number[x] >= 0 else same.any(axis=1)
                a, b = a[keep], b[keep]
            found.append((a, b))
        a, b = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1))
        return _blocks.rows(ids, n, a, b)

    checked = materialize(_blocks.compare(_blocks.paired(texts, "unit", "node", block, members), "unit", work), "links")
    linked = checked.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    grouped = components(checked.where("b IS NOT NULL").select("a", "b"))
    joined = classes.select("k1", "k2", "node", "rep", "n").join(linked.withColumnRenamed("a", "node"), "node", "left").join(grouped, "node", "left")
    joined = joined.select("k1", "k2", F.coalesce("component", "node").alias("node"), "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = joined.groupBy("node").agg(F.min("rep").alias("class_id"))
    of_class = joined.drop("rep").join(least, "node")
    return base.select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(of_class, ["k1", "k2"], "left")


def link(docs: DataFrame, **params) -> DataFrame:
    """doc_id, class_id, n_links and kept of each row; parameters: jaccard, width, miss, block, whole.

    Documents whose sets of shingles have a Jaccard similarity of at least ``jaccard`` are linked;
    n_links counts the other documents linked directly, class_id is the smallest doc_id reachable by
    links, kept marks the document of that id. Documents without words (null, empty) link with
    nothing; those with fewer than ``width`` words have one shingle of them all. Rows that repeat an id are
    documents of their own. Rows without an id link with nothing. Other columns are not looked at; an empty
    table gives no rows.
    """
    out = _classed(docs, **params).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _similar(sets: list[np.ndarray], jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of sets with at least that similarity: intersections by products of 0-1 matrices, a slab of shingles at a time."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    if n < 2:
        return (np.zeros(0, np.int64),) * 2
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    more = times[number] > 1
    owner, number = owner[more], (np.cumsum(times > 1) - 1)[number[more]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for low in range(0, int((times > 1).sum()), SLAB):
        x, y = np.searchsorted(number, [low, low + SLAB])
        matrix = np.zeros((n, SLAB), np.float32)
        matrix[owner[x:y], number[x:y] - low] = 1
        both += matrix @ matrix.T
    either = size[:, None] + size[None, :] - both
    a, b = np.nonzero(np.triu(both / np.maximum(either, 1) >= jaccard, 1))
    return a, b


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns, of one document for each class: that of the smallest doc_id.

    Of rows of that id in one class the text of the least hash stays, and of rows equal in id and text the
    one whose other columns have the least hash (columns of maps are not looked at for this). Two texts under
    one id that are not alike both stay. Rows without an id and those without words all stay.
    """
    classed = _classed(docs, **params)
    winner = classed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "print")).alias("w"))
    # the same id and text is one class, so each winner is of one class only
    winners = winner.select(F.col("w.doc_id").alias("_id"), F.col("w.print").alias("_print"))
    silent = classed.where("node IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).distinct()
    marked = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_print", F.xxhash64("text"))
    every = winners.withColumn("_one", F.lit(True)).unionByName(silent.withColumn("_one", F.lit(False)))
    stay = marked.where("doc_id IS NOT NULL").join(every, ["_id", "_print"])
    rest = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy("_id", "_print").orderBy(F.xxhash64(*rest)))
    stay = stay.withColumn("_n", nth).where("_n = 1 OR NOT _one")
    return stay.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
