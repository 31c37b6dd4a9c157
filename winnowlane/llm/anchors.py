"""Substring dedup over words with fixed-block anchors.

Every document's non-overlapping blocks of 18 words are indexed; every rolling window of 18 words
probes the index. A repeat of 35 words holds a whole block of either occurrence, so each window of
35 words that repeats has a hit within. Hits are then extended: the 35-word windows around them
meet their equals by 96-bit fingerprints, and runs of windows that do are the maximal repeats.
Each of the two meetings sends packed keys of chunks, never a row for a window or a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from winnowlane.llm import _bytes as B
from winnowlane.llm import _exchange as X
from winnowlane.llm._scratch import materialize

#: Words of a repeat that count.
WIDTH = 35
U = np.uint64
KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


class _Words:
    """Words of a chunk's texts; ``doc`` is the row of each word, ``left`` the words of its text from it on."""

    def __init__(self, column, width: int):
        self.data, offsets = B.text_buffer(column)
        self.starts, self.ends, self.first = B.word_bounds(self.data, offsets)
        n = len(self.starts)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        at = np.arange(n)
        self.index, self.left = at - self.first[:-1][self.doc], self.first[1:][self.doc] - at
        self.width, self.block, self._pairs = width, (width + 1) // 2, None

    def hashes(self, family: B.Family) -> np.ndarray:
        if self._pairs is None:
            self._pairs = B.word_pairs(self.data, self.starts, self.ends)
        return self._pairs[family.half]

    def windows(self, words: np.ndarray, family: B.Family, width: int) -> np.ndarray:
        """A hash for each word; it holds only where ``left`` >= width."""
        out = np.zeros(len(words), dtype=np.uint64)
        got = family.windows(words, width)
        out[: len(got)] = got
        return out

    def probes(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of all rolling windows of texts long enough, their keys, and which are blocks."""
        at = np.flatnonzero((self.left >= self.block) & (self.count[self.doc] >= self.width))
        h = self.windows(self.hashes(B.FIRST), B.FIRST, self.block)
        return at, X.place(h[at], n_buckets), self.index[at] % self.block == 0


def _kept(w: _Words, gone: np.ndarray) -> list[str]:
    """SHA-256 of each text's words that stay, joined by single spaces."""
    stay = np.flatnonzero(~gone)
    lens = w.ends[stay] - w.starts[stay]
    stop = np.cumsum(lens + 1)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    out[B.ragged(stop - lens - 1, lens)] = w.data[B.ragged(w.starts[stay], lens)]
    edge = np.r_[0, stop][np.searchsorted(stay, w.first)]
    view = memoryview(out)
    return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1], edge[1:])]


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``width`` words whose sequence also starts elsewhere.

    Returns doc_id, n_words, n_removed, kept_sha256 (and kept_text). A null text has no words; so has
    an empty one. Texts shorter than the width keep all words. Overlapping windows within one
    document repeat each other as windows of different documents do. Rows that repeat an id are
    documents of their own; other columns are not looked at; an empty table gives no rows. An id may be
    of any atomic type.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_buckets, chunks = X.buckets(docs), X.chunk_count(docs)
    dealt = X.chunked(docs.select("doc_id", "text"), chunks, "doc_id", "text")

    def ask(table: pa.Table) -> pa.Table:
        _, keys, is_block = _Words(table.column("text"), width).probes(n_buckets)
        every = np.unique(keys)
        block = np.zeros(len(every), bool)
        block[np.searchsorted(every, keys[is_block])] = True
        _, at = X.split_keys(every)
        return X.ask_rows(X.chunk_of(table), every, [np.packbits(block[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])])

    def answer(table: pa.Table) -> pa.Table:
        """A bit for each probe key: a block of another chunk has it."""
        keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        mine = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).view(bool) for x, k in zip(table.column("extra").to_pylist(), keys)]
        index, held = np.unique(np.concatenate([k[m] for k, m in zip(keys, mine)]), return_counts=True)
        bits = []
        for k, m in zip(keys, mine):
            at = np.minimum(np.searchsorted(index, k), max(len(index) - 1, 0))
            n = np.where(index[at] == k, held[at], 0) if len(index) else np.zeros(len(k), np.int64)
            bits.append(np.packbits(n - m > 0).tobytes())
        return X.reply_rows(table, bits)

    def rows(table: pa.Table, w: _Words, gone: np.ndarray, text: list | None, marks: list | None) -> pa.Table:
        n = len(w.count)
        removed = np.bincount(w.doc[gone], minlength=n)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(w.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(_kept(w, gone), pa.string()), "chunk": table.column("chunk"), "text": pa.array(text or [None] * n, pa.string()), "marks": pa.array(marks or [None] * n, pa.binary())})

    def anchor(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Documents without a hit are done; the others go on, with the windows that hold a hit."""
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(mid_names, mid_types)})
        w = _Words(table.column("text"), width)
        at, keys, is_block = w.probes(n_buckets)
        every, which = np.unique(keys, return_inverse=True)
        blocks = np.bincount(which[is_block], minlength=len(every))
        hit = np.zeros(len(w.starts), bool)
        hit[at] = X.read_bits(replies, every)[which] | (blocks[which] - is_block > 0) if len(at) else False
        # windows with a hit at one of their first ``block`` words: counts of hits from a word on
        run = np.r_[0, np.cumsum(hit)]
        n = len(hit)
        begin = np.arange(n)
        window = (run[np.minimum(begin + w.width - w.block + 1, n)] - run[begin] > 0) & (w.left >= w.width)
        some = np.bincount(w.doc[window], minlength=len(w.count)) > 0
        texts = table.column("text").to_pylist()
        marks = [np.packbits(window[a:b]).tobytes() if s else None for s, a, b in zip(some, w.first[:-1], w.first[1:])]
        return rows(table, w, np.zeros(n, bool), [t if s or with_text else None for t, s in zip(texts, some)], marks)

    mid_names = ["doc_id", "n_words", "n_removed", "kept_sha256", "chunk", "text", "marks"]
    mid_types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary()]
    mid = materialize(X.exchange(dealt, ask, answer, anchor, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, chunk int, text string, marks binary"), "anchors")
    open_ = X.deal(mid.where("marks IS NOT NULL").select("doc_id", "chunk", "text", "marks"))

    def wide(table: pa.Table) -> tuple[_Words, np.ndarray, np.ndarray, np.ndarray]:
        """Marked windows: positions; distinct 96-bit keys by bucket; the key of each."""
        w = _Words(table.column("text"), width)
        bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=int(n)) for m, n in zip(table.column("marks").to_pylist(), w.count)]
        at = np.flatnonzero(np.concatenate(bits)) if bits else np.zeros(0, np.int64)
        a = w.windows(w.hashes(B.FIRST), B.FIRST, width)[at]
        b = w.windows(w.hashes(B.SECOND), B.SECOND, width)[at]
        one, number = B.distinct(a, b)
        return w, at, np.stack([a[one], b[one]]), number

    def by_bucket(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bucket = ((keys[0] >> U(32)) % U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        which, at = np.unique(bucket[order], return_index=True)
        return order, which, np.r_[at, len(order)]

    def ask_wide(table: pa.Table) -> pa.Table:
        _, _, keys, _ = wide(table)
        order, which, at = by_bucket(keys)
        packed = np.empty(len(order), KEY)
        packed["a"], packed["b"] = keys[0][order], keys[1][order].astype(np.uint32)
        return pa.table({"chunk": pa.array(np.full(len(which), X.chunk_of(table), np.int32)), "bucket": pa.array(which.astype(np.int32)), "keys": pa.array([packed[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary()), "extra": pa.array([b""] * len(which), pa.binary())})

    def answer_wide(table: pa.Table) -> pa.Table:
        """A bit for each window key: another chunk has it too."""
        keys = [np.frombuffer(k, KEY) for k in table.column("keys").to_pylist()]
        every = np.concatenate(keys)
        _, number = B.distinct(every["a"], every["b"].astype(np.uint64))
        more = (np.bincount(number) > 1)[number]
        ends = np.cumsum([len(k) for k in keys])
        return X.reply_rows(table, [np.packbits(more[e - len(k) : e]).tobytes() for k, e in zip(keys, ends)])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(mid_names, mid_types)}).select(done)
        w, at, keys, number = wide(table)
        order, which, edge = by_bucket(keys)
        spot = {int(b): order[x:y] for b, x, y in zip(which, edge[:-1], edge[1:])}
        again = np.bincount(number, minlength=keys.shape[1]) > 1
        for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
            own = spot[bucket]
            again[own] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).view(bool)
        mark = np.zeros(len(w.starts), bool)
        mark[at[again[number]]] = True
        gone = B.covered(mark, width, len(mark))
        out = rows(table, w, gone, None, None)
        if with_text:
            out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(_texts(w, gone), pa.string()))
        return out.select(done)

    done = mid_names[:4] + (["text"] if with_text else [])
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    extended = X.exchange(open_, ask_wide, answer_wide, finish, schema)
    out = mid.where("marks IS NULL").select(*done).unionByName(extended)
    if with_text:
        out = out.withColumn("text", F.coalesce("text", F.lit(""))).withColumnRenamed("text", "kept_text")
    return out


def _texts(w: _Words, gone: np.ndarray) -> list[str]:
    raw = w.data.tobytes()
    return [" ".join(raw[w.starts[i] : w.ends[i]].decode() for i in range(a, b) if not gone[i]) for a, b in zip(w.first[:-1], w.first[1:])]
