"""Document fingerprints by I-Match.

Terms whose inverse document frequency lies in a band are the lexicon; the document frequency of every
term is asked for. Each of DRAWS randomised lexicons is a random subset of it, at a rate from a quarter down
to 1 / 2**12, LEVELS rates in turn. The sorted distinct terms of a text that a randomised lexicon holds are hashed, all of
them; where it holds none of a text's, the whole lexicon stands in for it. So texts that differ in a few terms
agree under the lexicons that hold none of those, whatever their length, and the share of equal
hashes tells how alike two texts are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowlane.llm import _bytes as B
from winnowlane.llm import _exchange as X

DRAWS, LEVELS = 66, 11
#: A term is kept if at least LEAST_DOCS documents and at most this share of all documents have it.
LEAST_DOCS, MOST_SHARE = 2, 0.1
#: Bytes of stored documents for each chunk; the edited texts double them.
CHUNK_BYTES = 1_600_000
#: Bounds of chunks are broadcast up to so many (16 MB); beyond it they meet the documents by a shuffle.
BROADCAST_CHUNKS = 1_000_000
U = np.uint64


def _code_points(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def rate_bits(draw: int) -> int:
    """The lexicon of a draw holds a term of the band with probability 2**-rate_bits."""
    return 2 + draw % LEVELS


def _fingerprints(text: np.ndarray, term: np.ndarray, n: int, draws: int) -> np.ndarray:
    """Hashes (n, draws) of n texts from distinct (text, term) pairs sorted by text and term; 0: no term."""
    out = np.zeros((n, draws), dtype=np.uint64)
    if not len(text):
        return out
    at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    own = B.mix(term ^ U(0xA5A5A5A5))
    whole = np.add.reduceat(own, at)
    for k, odd in enumerate(B.stream(0x1A7C4, draws) | U(1)):
        # the lexicon of a draw: terms whose place under its multiplier begins with so many zero bits
        inside = np.flatnonzero(term * odd < U(1 << (64 - rate_bits(k))))
        summed = whole.copy()
        if len(inside):
            owner = text[inside]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            summed[np.searchsorted(text[at], owner[first])] = np.add.reduceat(own[inside], first)
        out[text[at], k] = B.mix(summed) | U(1)
    return (out >> U(32)) | (out & U(1))


def _dealt(docs: DataFrame) -> DataFrame:
    """Documents in chunks of consecutive ids; each chunk also gets the first document of the next as a guest."""
    n = X.chunk_count(docs, CHUNK_BYTES)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    low = ids.agg(F.min("doc_id")).head()[0]
    cuts = [] if low is None or n == 1 else sorted({x for x in ids.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if x > low})
    plain = docs.select("doc_id", "text")
    if not cuts:
        return X.deal(plain.withColumn("chunk", F.lit(0)).withColumn("guest", F.lit(False)))
    deal = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="bin", handleInvalid="keep")
    at = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.col("bin")).cast("int")
    own = deal.transform(plain.withColumn("place", F.col("doc_id").cast("double"))).select("doc_id", "text", at.alias("chunk"), F.lit(False).alias("guest"))
    firsts = [(float(x), i) for i, x in enumerate(cuts)] + [(float(low), len(cuts))]
    heads = docs.sparkSession.createDataFrame(firsts, "place double, chunk int")
    heads = F.broadcast(heads) if len(firsts) <= BROADCAST_CHUNKS else heads
    guests = plain.withColumn("place", F.col("doc_id").cast("double")).join(heads, "place").select("doc_id", "text", "chunk", F.lit(True).alias("guest"))
    return X.deal(own.unionByName(guests))


class _Chunk:
    """A chunk's texts: its documents in order, the guest, and each document edited with its follower."""

    def __init__(self, table: pa.Table):
        rows = table.select(["guest", "doc_id", "text"]).sort_by([("guest", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        guest = rows.column("guest").to_numpy()
        self.n = int((~guest).sum())
        rows = rows.slice(0, min(len(rows), self.n + 1))
        self.ids = rows.column("doc_id").slice(0, self.n)
        data, at = B.text_buffer(rows.column("text"))
        starts = np.flatnonzero(_code_points(data))
        point = np.r_[starts, len(data)]
        first = np.searchsorted(starts, at)  # number of each text's first code point
        self.n_chars = np.diff(first)[: self.n]
        follower = np.r_[np.arange(1, self.n), self.n if len(rows) > self.n else 0]
        raw, edited = data.tobytes(), []
        for i, j in zip(range(self.n), follower):
            m = int(self.n_chars[i]) // 4
            take = min(m, int(first[j + 1] - first[j]))
            edited.append(raw[at[i] : point[first[i + 1] - m]] + raw[at[j] : point[first[j] + take]])
        self.edited, self.follower = edited, follower
        lens = np.fromiter(map(len, edited), np.int64, self.n)
        both = np.frombuffer(raw + b"".join(edited), np.uint8)
        offsets = np.r_[at, at[-1] + np.cumsum(lens)]
        self.texts = len(offsets) - 1
        w0, w1, begin = B.word_bounds(both, offsets)
        if not len(w0):
            self.terms, self.text, self.term = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        h = B.FIRST.words(both, w0, w1)
        self.terms, number = np.unique(h, return_inverse=True)
        owner = np.repeat(np.arange(self.texts, dtype=np.uint64), np.diff(begin))
        pair = np.unique((owner << U(32)) | number.astype(np.uint64))
        self.text, self.term = (pair >> U(32)).astype(np.int64), (pair & U(0xFFFFFFFF)).astype(np.int64)

    def counts(self) -> np.ndarray:
        """Of each term, how many of the chunk's own documents have it."""
        return np.bincount(self.term[self.text < self.n], minlength=len(self.terms))


def fingerprint(docs: DataFrame, draws: int = DRAWS, least_docs: int = LEAST_DOCS, most_share: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how alike they and the next document's are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A
    null text counts as empty. An empty text or one without words has an empty fingerprint, which is
    alike (1) to an empty one only. A text without any term in the band is hashed over all its
    terms. Documents follow each other by doc_id, equal ids by text, null ids last; a single
    document follows itself. Document frequencies count every document. Rows that repeat an id are
    documents of their own; ids are integral, others are refused; other columns are not looked at; an
    empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
    if kind not in types:
        raise TypeError(f"doc_id must be integral, not {kind}")
    dealt = _dealt(docs)
    n_buckets, total = X.buckets(docs), docs.count()
    most = max(least_docs, math.floor(total * most_share))

    def ask(table: pa.Table) -> pa.Table:
        c = _Chunk(table)
        if not c.n:
            return X.ask_rows(X.chunk_of(table), np.zeros(0, U))
        keys, which = np.unique(X.place(c.terms, n_buckets), return_inverse=True)
        seen = np.bincount(which, weights=c.counts(), minlength=len(keys))
        seen = seen.astype(np.uint8 if not len(seen) or seen.max() < 256 else np.uint32)
        _, at = X.split_keys(keys)
        return X.ask_rows(X.chunk_of(table), keys, [seen[a:b].tobytes() for a, b in zip(at[:-1], at[1:])])

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        seen = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == len(k) else np.uint32).astype(np.uint32) for k, x in zip(keys, table.column("extra").to_pylist())])
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(which, weights=seen, minlength=len(every))
        good = ((df >= least_docs) & (df <= most))[which]
        ends = np.cumsum([len(k) for k in keys])
        return X.reply_rows(table, [np.packbits(good[e - len(k) : e]).tobytes() for k, e in zip(keys, ends)])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in out})
        c = _Chunk(table)
        keys, which = np.unique(X.place(c.terms, n_buckets), return_inverse=True)
        inside = X.read_bits(replies, keys)[which] if len(keys) else np.zeros(0, bool)
        good = inside[c.term]
        some = np.zeros(c.texts, bool)
        some[c.text[good]] = True
        good |= ~some[c.text]
        prints = _fingerprints(c.text[good], c.terms[c.term[good]], c.texts, draws)
        offset = c.texts - c.n
        own, edited, after = prints[: c.n], prints[offset:], prints[c.follower]
        texts = [p.tobytes().hex() if p.any() else "" for p in prints.astype(">u4")]
        return pa.table([
            c.ids, pa.array(c.n_chars, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in c.edited], pa.string()),
            pa.array(texts[: c.n], pa.string()), pa.array(texts[offset:], pa.string()), pa.array((own == edited).mean(axis=1)), pa.array((own == after).mean(axis=1)),
        ], schema=out)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = pa.schema([("doc_id", types[kind]), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return X.exchange(dealt, ask, answer, finish, schema)
