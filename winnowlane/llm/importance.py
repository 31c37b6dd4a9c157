"""Importance resampling towards a target text collection, by hashed n-gram features.

Features are runs of one to three consecutive words; the bucket of a feature is the CRC-32 of its bytes.
The CRC of a run is composed of those of its words: appending n bytes to a text multiplies its CRC by a
matrix over GF(2) that depends on n alone, so each word's CRC is computed once and no run is ever
spelled out. Counts of buckets, here and in the target, give each bucket a gain; a document's weight is
the sum of its features' gains, and adding Gumbel noise of its id to it draws without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from winnowlane.llm import _bytes as B
from winnowlane.llm._scratch import materialize
from winnowlane.llm.bpe import text_batches
from winnowlane.operators.order import positions

#: Longest run of words, and buckets. The counts of all buckets are held by the driver and by every task: 80 KB each.
RUN, BUCKETS = 3, 10_000
#: Drawn of a hundred documents that have at least LEAST_WORDS words.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Words whose runs are worked on at once.
SLAB = 1 << 20
#: Lengths with a matrix of their own; longer ones are sums of powers of two. Words longer than this are hashed one by one.
SHORT = 64

U = np.uint32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes between words, once A to Z are lower case.
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[0x30:0x3A] = _BETWEEN[0x61:0x7B] = _BETWEEN[0x80:] = False


def _one_byte() -> np.ndarray:
    """What the low byte of a CRC register adds when the register moves on by a byte."""
    t = np.arange(256, dtype=U)
    for _ in range(8):
        t = np.where(t & 1, (t >> U(1)) ^ U(0xEDB88320), t >> U(1))
    return t


STEP = _one_byte()


def _matrices() -> tuple[np.ndarray, np.ndarray]:
    """Length-shift matrices as four tables of a register's bytes: for 0 to SHORT - 1 bytes, and for 2**k bytes."""
    one = np.arange(256, dtype=U)[None, :] << (U(8) * np.arange(4, dtype=U))[:, None]
    short = [one]
    for _ in range(SHORT):
        short.append(STEP[short[-1] & U(255)] ^ (short[-1] >> U(8)))
    powers = [short[1]]
    for _ in range(40):
        powers.append(_times(powers[-1], powers[-1]))
    return np.stack(short[:SHORT]), np.stack(powers)


def _times(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return matrix[0][crc & U(255)] ^ matrix[1][(crc >> U(8)) & U(255)] ^ matrix[2][(crc >> U(16)) & U(255)] ^ matrix[3][crc >> U(24)]


SHORT_SHIFTS, POWER_SHIFTS = _matrices()


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs as they count once ``size`` more bytes follow: shifted(crc(a), len(b)) ^ crc(b) is crc(a + b)."""
    low = size & (SHORT - 1)
    out = SHORT_SHIFTS[low, 0, crc & U(255)] ^ SHORT_SHIFTS[low, 1, (crc >> U(8)) & U(255)] ^ SHORT_SHIFTS[low, 2, (crc >> U(16)) & U(255)] ^ SHORT_SHIFTS[low, 3, crc >> U(24)]
    rest = size >> 6
    for k in range(int(rest.max()).bit_length() if len(rest) else 0):
        at = np.flatnonzero(rest >> k & 1)
        out[at] = _times(POWER_SHIFTS[6 + k], out[at])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range: one array pass for each place in the words."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT), kind="stable")
    at, left = starts[order], np.minimum(size, SHORT)[order]
    crc = np.full(len(order), 0xFFFFFFFF, U)
    for i in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -i, "left"))
        c = crc[:n]
        crc[:n] = STEP[(c ^ data[at[:n] + i]) & U(255)] ^ (c >> U(8))
    out = np.empty(len(order), U)
    out[order] = ~crc
    long_ = np.flatnonzero(size > SHORT)
    if len(long_):
        raw = memoryview(np.ascontiguousarray(data))
        out[long_] = [zlib.crc32(raw[a:b]) for a, b in zip(starts[long_].tolist(), ends[long_].tolist())]
    return out


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of every word of a column of texts, and for each text the number of its first word."""
    data, offsets = B.text_buffer(column)
    data = _LOWER[data]
    starts, ends, first = B.word_bounds(data, offsets, _BETWEEN)
    return word_crcs(data, starts, ends), ends - starts, first


def features(crc: np.ndarray, size: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index of the first word and CRC of every run of up to RUN words of one document, SLAB words at a time."""
    blank = np.array([zlib.crc32(b" ")], U)
    for low in range(0, len(crc), SLAB):
        n = min(SLAB, len(crc) - low)
        at, run = np.arange(low, low + n), crc[low : low + n]
        yield at, run
        for k in range(1, RUN):
            keep = at + k < len(crc)
            at, run = at[keep], run[keep]
            keep = doc[at] == doc[at + k]
            at, run = at[keep], run[keep]
            run = _times(SHORT_SHIFTS[1], run) ^ blank  # a blank follows
            run = shifted(run, size[at + k]) ^ crc[at + k]
            yield at, run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """bucket and n: how many features of all whole texts fall in each bucket. A task sums its own before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in text_batches(batches, "text"):
            crc, size, first = words_of(batch.column("text"))
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for _, found in features(crc, size, doc):
                n += np.bincount(found % U(buckets), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """For each bucket floor(1000 ln(share in the target / share here)), shares smoothed by one feature a bucket."""
    held = np.zeros((2, buckets), np.int64)
    for side, frame in enumerate((docs, target)):
        for r in bucket_counts(frame, buckets).collect():  # at most ``buckets`` rows
            held[side, r.bucket] = r.n
    here, there = (int(x.sum()) for x in held)
    return [math.floor(1000 * math.log((t + 1) * (here + buckets) / ((s + 1) * (there + buckets)))) for s, t in zip(*held.tolist())]


def weigh(docs: DataFrame, gain: list[int], seed: int = SEED, with_text: bool = True) -> DataFrame:
    """The columns of docs (the text only if asked for), and _words, _features, _weight and _score of each document."""
    clash = {"_words", "_features", "_weight", "_score"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    value = np.array(gain, np.int64)
    kept = [f for f in docs.schema.fields if with_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            crc, size, first = words_of(batch.column("text"))
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            weight, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for at, found in features(crc, size, doc):
                # sums of whole numbers below 2**53 are exact in doubles
                weight += np.bincount(doc[at], weights=value[found % U(len(value))], minlength=len(n)).astype(np.int64)
                count += np.bincount(doc[at], minlength=len(n))
            columns = {f.name: batch.column(f.name) for f in kept} | {"_words": pa.array(n, pa.int64()), "_features": pa.array(count, pa.int64()), "_weight": pa.array(weight, pa.int64())}
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    schema = StructType([*kept]).add("_words", "long").add("_features", "long").add("_weight", "long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return docs.mapInArrow(run, schema).withColumn("_score", (F.col("_weight") + noise).cast("long"))


def _order() -> list:
    """The order of draws. Rows equal in all of it have one id and one text."""
    return [F.col("_score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_print").asc()]


def rank(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null where not drawn) of each document, all long.

    ``percent`` of a hundred documents with at least ``least_words`` words are drawn, highest score first, ties to the
    smaller doc_id. A null or empty text has no features, weight 0 and a score, and is not drawn; a
    null id counts as an empty one and comes last among ties. Rows that repeat an id are documents of their own
    with the same noise. Other columns are not looked at; empty tables give no rows, and an empty target
    gains that favour rare buckets alike.
    """
    return _ranked(docs, gains(docs, target, buckets), percent, least_words, seed).select("doc_id", F.col("_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), "rank")


def _ranked(docs: DataFrame, gain: list[int], percent: int, least_words: int, seed: int) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_print"))
    scored = materialize(weigh(plain, gain, seed, with_text=False), "weights")
    placed = positions(scored.where(F.col("_words") >= least_words), None, _order())
    drawn = F.col("pos") < F.floor(F.col("_n") * percent / 100)
    ranked = placed.withColumn("rank", F.when(drawn, F.col("pos") + 1).cast("long")).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(F.col("_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that rank() draws, all columns.

    Only the last row drawn is looked up; documents are then filtered by their score as they are read, so no text
    is sorted or sent. Of rows equal in id and text at that border as many stay as were drawn. The names _words, _features,
    _weight and _score must be free.
    """
    gain = gains(docs, target, buckets)
    drawn = _ranked(docs, gain, percent, least_words, seed).where("rank IS NOT NULL")
    last = drawn.groupBy().agg(F.max(F.struct("rank", "_score", "doc_id", "_print")).alias("last"), F.count("*").alias("n")).first()
    if not last.n:
        return docs.limit(0)
    score, key, text = last["last"]["_score"], last["last"]["doc_id"], last["last"]["_print"]
    id_ = F.col("doc_id").cast("long")
    same_id = id_.eqNullSafe(F.lit(key).cast("long"))
    before_id = F.col("doc_id").isNotNull() if key is None else F.coalesce(id_ < key, F.lit(False))
    tied, print_ = F.col("_score") == score, F.xxhash64("text")
    found = weigh(docs, gain, seed).where(F.col("_words") >= least_words)
    sure = found.where((F.col("_score") > score) | (tied & (before_id | (same_id & (print_ < text)))))
    equal = same_id & (print_ == text)
    at_border = drawn.where(tied & same_id & (F.col("_print") == text)).count()
    return sure.unionByName(found.where(tied & equal).limit(at_border)).select(*docs.columns)
