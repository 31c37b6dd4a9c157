"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, probed by every window of every document.

Windows of ten consecutive words of each benchmark item, lower-cased (A to Z), are a set that is broadcast;
every window of every whole document looks itself up by hash, and a hit is verified by comparing its words. Words
inside hits are counted, and spans or documents with hits can be removed. DataFrame functions only; a
document is split into words once, and no row is sent for a window without a hit.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowlane.llm._scratch import materialize
from winnowlane.llm.disclosure import _folded, _let

#: Words of a window. Items of fewer words are one window.
WIDTH = 10
#: (window, item) pairs that one scan broadcasts, of some 200 bytes each; a larger benchmark is looked up in several scans.
BROADCAST_WINDOWS = 500_000
# What lies between words once A to Z are lower case, and what a word is in a text as it stands.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPANS = "array<struct<pos:int,len:int>>"
_MINE = ("_id", "_text", "_spans")


def words(text: Column) -> Column:
    """Lower-cased (A to Z) words of a text; a null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(plain, BETWEEN), "")


def _window(hashes: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), F.slice(hashes, at, F.lit(width)))


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """hash, len, tokens and items (ids of the items that have it, as strings) of each distinct window of the benchmark."""
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    item = item.withColumn("len", F.least(F.size("w"), F.lit(width)))
    every = item.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("tokens"))
    found = every.groupBy("len", "tokens").agg(F.collect_set("item").alias("items"))
    return found.select(F.xxhash64("len", _hashed(F.col("tokens"))).alias("hash"), "len", "tokens", "items")


def _runs(lengths: list[int]) -> Column:
    """Hashes of a document's windows of each length, one length after another, behind a first one of 0 that stands for the document."""
    n, none = F.size("_words"), F.array().cast("array<bigint>")

    def of(hashes: Column, width: int) -> Column:
        at = F.sequence(F.lit(1), n - width + 1)
        return F.when(n >= width, F.transform(at, lambda i: _window(hashes, i, width))).otherwise(none)

    # words are hashed once, not once for each window
    return _let(_hashed(F.col("_words")), lambda hashes: F.concat(F.array(F.lit(0).cast("bigint")), *[of(hashes, w) for w in lengths]))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, _print (of the text), _n_words, _copies (rows of that id and text), _spans (pos and len of each hit window) and _items.

    One row for each id and text. The documents are scanned once for every ``broadcast`` pairs of window and item.
    """
    known = materialize(windows(benchmark, width), "windows")
    sizes = known.groupBy("len").agg(F.sum(F.size("items")).alias("n")).orderBy("len").collect()  # ``width`` rows at most
    lengths, scans = [r["len"] for r in sizes], max(1, -(-sum(r["n"] for r in sizes) // broadcast))
    tokens = docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("_print"), words(F.col("text")).alias("_words"))
    # where each length's windows begin among those of its document
    begins, before = [], F.lit(1)
    for w in lengths:
        begins.append(before)
        before = before + F.greatest(F.lit(0), F.size("_words") - w + 1)
    begin = reduce(lambda c, x: c.when(F.col("len") == x[0], x[1]), zip(lengths, begins), F.when(F.lit(False), F.lit(0)))
    parts = []
    for scan in range(scans):
        mine = known if scans == 1 else known.where(F.pmod(F.col("hash"), F.lit(scans)) == scan)
        # the row that stands for a document: it meets the first hash of each
        none = F.array().cast("array<string>")
        alone = docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("hash"), F.lit(0).alias("len"), none.alias("tokens"), none.alias("items"))
        # of an array that is never empty, so "outer" changes nothing but that no filter computes it once more
        probe = tokens.withColumn("_runs", _runs(lengths)).select("doc_id", "_print", "_words", F.posexplode_outer("_runs").alias("at", "hash"))
        met = probe.join(F.broadcast(mine.unionByName(alone)), "hash")
        pos = F.when(F.col("len") == 0, F.lit(-1)).otherwise(F.col("at") - begin)
        same = F.when(F.col("len") == 0, F.col("at") == 0).otherwise((F.col("pos") >= 0) & (F.slice("_words", F.col("pos") + 1, F.col("len")) == F.col("tokens")))
        parts.append(met.withColumn("pos", pos).where(same).select("doc_id", "_print", F.size("_words").alias("n"), "pos", "len", "items", F.lit(scan).alias("scan")))
    hit = F.col("len") > 0
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "_print").agg(
        F.max("n").alias("_n_words"),
        F.sum(F.when(~hit & (F.col("scan") == 0), 1).otherwise(0)).alias("_copies"),
        F.array_sort(F.collect_set(F.when(hit, F.struct("pos", "len")))).cast(_SPANS).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("_items"),
    )


def _covered(spans: Column) -> Column:
    """How many words sorted spans cover; where they overlap once."""
    start = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        stop = s["pos"] + s["len"]
        return F.struct(F.greatest(acc["stop"], stop).alias("stop"), (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["stop"], s["pos"]))).cast("bigint").alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    Null and empty texts have no words, nor hits; an item without words has no windows. Rows of the benchmark that
    repeat an id are one item, rows without an id are one item named by the empty string. Rows of docs that repeat an id
    are documents of their own. Other columns are not looked at; an empty table of documents gives no rows,
    an empty benchmark no hits.
    """
    found = matches(docs.select("doc_id", "text"), benchmark, width, broadcast)
    out = found.select(
        "doc_id", F.col("_n_words").cast("long").alias("n_words"), _covered(F.col("_spans")).alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"), "_copies",
    )
    return out.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("_copies")


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = True, width: int = WIDTH, broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """The columns of docs: with ``spans`` the words of hits, and what stands before each of them, are cut out; else documents with hits go.

    Texts without hits stay as they are, null ones too; n_chars, if there, is counted anew where text changed. The names _id,
    _text and _spans must be free.
    """
    clash = set(_MINE) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    hits = materialize(matches(docs.select("doc_id", "text"), benchmark, width, broadcast).where(F.size("_spans") > 0).select(F.col("doc_id").alias("_id"), F.col("_print").alias("_text"), "_spans"), "hits")
    print_ = F.xxhash64("text", F.length("text"))
    on = docs["doc_id"].eqNullSafe(hits["_id"]) & (print_ == hits["_text"])
    if not spans:
        return docs.join(hits, on, "left_anti")
    gaps = F.split("text", WORD, -1)
    pieces = _let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda found: F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, w: F.concat(g, w)))

    def step(at: Column, s: Column) -> Column:
        # what is kept between the spans before and this one
        return F.struct(F.greatest(at, s["pos"] + s["len"]).alias("state"), F.struct(at.alias("low"), F.greatest(F.lit(0), s["pos"] - at).alias("n")).alias("out"))

    last = F.aggregate("_spans", F.lit(0), lambda acc, s: F.greatest(acc, s["pos"] + s["len"]))
    kept = _folded(F.col("_spans"), F.lit(0), "struct<low:int,n:int>", step)

    def cut(p: Column) -> Column:
        inner = F.flatten(F.transform(kept, lambda k: F.slice(p, k["low"] + 1, k["n"])))
        return F.concat(F.array_join(inner, ""), F.array_join(F.slice(p, last + 1, F.size(p)), ""), F.element_at(gaps, -1))

    changed = F.col("_spans").isNotNull()
    out = docs.join(hits, on, "left").withColumn("text", F.when(changed, _let(pieces, cut)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
