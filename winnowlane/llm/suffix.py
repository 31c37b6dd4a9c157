"""Suffix-array dedup of bytes by threshold-bounded interval expansion.

A Burrows-Wheeler transform of a shard of text is extended backward breadth first: step l finds
the rows whose common prefix with the row above is of l bytes, from the boundaries known after
step l - 1, and it stops at the length that counts. Rows without a boundary between them then share
at least that many bytes. Shards hold all that can match: every string of 50 bytes has a minimal
28-byte gram (leftmost of the least hashes), equal strings have the same one, and the pieces of
text around a gram go to its shard. Grams of one document alone are sorted out before, by packed
keys of chunks; a piece that is alone with its gram needs no transform. Documents that equal one
of a smaller id go first, by their digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowlane.llm import _bytes as B
from winnowlane.llm import _exchange as X
from winnowlane.llm._scratch import materialize

#: Bytes of a repeat that count, and of the gram that stands for it.
LENGTH, GRAM = 50, 28
#: Bytes of stored documents for each chunk: a chunk's work takes some hundred bytes of memory for each of text.
CHUNK_BYTES = 1_000_000
NO_ID = 2**63 - 1
SALT = 16
U = np.uint64
HEAD = np.dtype([("size", "<u2"), ("at", "<u2"), ("least", "<i8")])


#: Symbols that are ranked at once to begin with, of nine bits each.
FIRST = 4
#: Symbols of pieces that are sorted together, and grams compared together: what fits a core's cache.
SYMBOLS, GRAMS = 1 << 16, 1 << 15


def dense(key: np.ndarray, bits: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Dense ranks of keys of so many bits, positions in order of key (and position, if few or some are ``apart``), and the number of ranks. Positions ``apart`` share no rank."""
    n = len(key)
    low = max(1, (n - 1).bit_length())
    if bits + low <= 64:  # key and position are one number
        key = np.sort((key << U(low)) | np.arange(n, dtype=np.uint64))
        order = (key & U((1 << low) - 1)).astype(np.int64)
        key >>= U(low)
    else:
        order = np.argsort(key, kind=None if apart is None else "stable")
        key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    if apart is not None:
        new |= apart[order]
    number = np.cumsum(new) - 1
    rank = np.empty(n, np.int64)
    rank[order] = number
    return rank, order, int(number[-1]) + 1


def first_ranks(symbols: np.ndarray, unique_from: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Ranks of suffixes by their first symbols, up to the end of their piece; None if ends of pieces don't rise, or symbols are too many.

    Equal beginnings that hold an end are told apart by it, and so by their position.
    """
    ends = np.flatnonzero(symbols >= unique_from)
    if not 0 < unique_from < 512 or not len(ends) or ends[-1] != len(symbols) - 1 or (np.diff(symbols[ends]) <= 0).any():
        return None
    n = len(symbols)
    left = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)  # symbols up to the piece's end
    code = np.minimum(symbols, unique_from).astype(np.uint64)
    key = code.copy()
    for k in range(1, FIRST):
        key <<= U(9)
        key[: n - k] |= np.where(left[: n - k] >= k, code[k:], U(0))
    return dense(key, 9 * FIRST, left < FIRST)


def suffix_rows(symbols: np.ndarray, unique_from: int | None = None, depth: int | None = None) -> np.ndarray:
    """The suffix array of an integer text, by prefix doubling, as far as the first ``depth`` symbols order it (by position then). Symbols of ``unique_from`` or more, if given, occur once each."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    found, step = first_ranks(symbols, unique_from) if unique_from is not None else None, FIRST
    if found is None:
        found, step = dense(symbols.astype(np.uint64), 64), 1
    rank, rows, distinct = found
    while distinct < n and (depth is None or step < depth):
        wide = distinct.bit_length()
        key = rank.astype(np.uint64) << U(wide)
        key[:-step] |= rank[step:].astype(np.uint64) + U(1)
        rank, rows, distinct = dense(key, 2 * wide)
        step *= 2
    return rows


def expand(symbols: np.ndarray, unique_from: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a text (as far as ``length`` symbols order it), and for each of its rows whether it shares fewer than ``length`` symbols with the row above.

    Symbols of ``unique_from`` or more occur once each (they end pieces), so nothing matches across them. Rows that share
    ``length`` symbols may stand in any order: none of the boundaries looked for is between them, nor between their suffixes one symbol shorter.
    """
    rows = suffix_rows(symbols, unique_from, length)
    n = len(rows)
    # the symbol before each suffix is the transform; the text is cyclic, its last symbol unique. The transform sorted, rows
    # of equal symbols in order, is the first symbols of the rows; each comes from the row of the suffix one symbol shorter
    rank = np.empty(n, np.int64)
    rank[rows] = np.arange(n)
    back = rank[np.where(rows + 1 < n, rows + 1, 0)]
    first = symbols[rows]
    bound = np.ones(n, dtype=bool)
    bound[1:] = (first[1:] != first[:-1]) | (first[1:] >= unique_from)
    open_ = np.flatnonzero(~bound)
    here, above = back[open_], back[open_ - 1]
    for _ in range(1, length):
        if not len(open_):
            break
        upto = np.cumsum(bound, dtype=np.int32)
        new = upto.take(here) != upto.take(above)
        bound[open_[new]] = True
        open_, here, above = open_[~new], here[~new], above[~new]
    return rows, bound


def shares(items: np.ndarray, kind: np.ndarray, size: np.ndarray):
    """Items, in order of kind, parted where the kind changes: of at most SYMBOLS in all, if one kind has not more."""
    done, edge = np.cumsum(size), np.r_[np.flatnonzero(np.diff(kind)) + 1, len(items)]
    x = 0
    while x < len(items):
        most = np.searchsorted(done, (done[x - 1] if x else 0) + SYMBOLS, "right")
        k = np.searchsorted(edge, most, "right") - 1
        y = int(edge[k]) if k >= 0 and edge[k] > x else int(edge[np.searchsorted(edge, x, "right")])
        yield items[x:y]
        x = y


def least_grams(data: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each run of ``width`` of them the position of the leftmost least.

    Least is judged by the upper 48 bits of a hash; the lower 16 hold the place in a share of the data meanwhile.
    """
    n = len(data) - gram + 1
    grams, at = np.empty(n, U), np.empty(n - width + 1, np.int64)
    place = np.arange(GRAMS + width, dtype=np.uint64)
    for x in range(0, len(at), GRAMS):
        y = min(x + GRAMS, len(at)) + width - 1
        own = B.FIRST.bytes_windows(data[x : y + gram - 1], gram)
        grams[x:y] = own
        value, have = (own & ~U(0xFFFF)) | place[: y - x], 1
        while have < width:
            step = min(have, width - have)
            value = np.minimum(value[step:], value[: len(value) - step])
            have += step
        at[x : x + len(value)] = (value & U(0xFFFF)).astype(np.int64) + x
    return grams, at


class _Bytes:
    """Bytes of a chunk's texts, and the pieces around their grams: windows of one document, one after another, with the same gram."""

    def __init__(self, column, length: int):
        self.data, self.offsets = B.text_buffer(column)
        self.length, n = length, len(self.data)
        size = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        if n < length:
            self.gram_at = self.start = self.stop = self.owner = np.zeros(0, np.int64)
            self.key = np.zeros(0, U)
            return
        gram = min(GRAM, length)
        grams, at = least_grams(self.data, gram, length - gram + 1)
        ok = self.doc[: len(at)] == self.doc[length - 1 :]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | ~ok[:-1] | (self.doc[1 : len(at)] != self.doc[: len(at) - 1])
        starts = np.flatnonzero(new & ok)
        last = np.ones(len(at), dtype=bool)
        last[:-1] = new[1:] | ~ok[1:]
        self.start, self.stop = starts, np.flatnonzero(last & ok) + length
        self.gram_at = at[starts]
        self.key, self.owner = grams[self.gram_at], self.doc[starts].astype(np.int64)


def _copies(docs: DataFrame, length: int) -> DataFrame:
    """A marker (no text) for each document that equals one of a smaller id, and so goes as a whole.

    Only digests and ids are dealt for this, the least id of each digest found by map-side sums.
    """
    ids = docs.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).select("doc_id", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("print"))
    least = ids.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("most > least").select("digest", "least")
    # a digest that very many documents have is shared among tasks
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    found = ids.withColumn("salt", F.pmod("doc_id", F.lit(SALT)).cast("int")).join(least, ["digest", "salt"]).where("doc_id > least").select("doc_id", F.lit(None).cast("string").alias("text"), "print").distinct()
    return found.withColumn("copy", F.lit(True))


def _parted(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """A chunk's documents without those that markers name; and those."""
    if not table.num_rows:
        return table, table
    marker = table.column("copy").to_numpy()
    named = set(zip(table.column("doc_id").filter(pa.array(marker)).to_pylist(), table.column("print").filter(pa.array(marker)).to_pylist()))
    docs = table.filter(pa.array(~marker))
    if not named:
        return docs, docs.slice(0, 0)
    gone = np.array([p in named for p in zip(docs.column("doc_id").to_pylist(), docs.column("print").to_pylist())], bool)
    return docs.filter(pa.array(~gone)), docs.filter(pa.array(gone))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id.

    Returns doc_id (integral), n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (and
    kept_text, where bytes cut in the middle of a character are replaced). Null texts count as empty.
    Rows that repeat an id are documents of the same id, none smaller; null ids are larger than
    all others and equal to each other. Other columns are not looked at; an empty table gives no rows.
    """
    n_buckets, chunks = X.buckets(docs), X.chunk_count(docs, CHUNK_BYTES)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = X.chunked(plain.withColumn("print", F.xxhash64("text")).withColumn("copy", F.lit(False)).unionByName(_copies(plain, length)), chunks, "doc_id")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    done = names + (["kept_text"] if with_text else [])
    mid_schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, chunk int, text string, marks binary"
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    mid = {c.split()[0]: types[c.split()[1]] for c in mid_schema.split(", ")}

    def ids_of(table: pa.Table) -> np.ndarray:
        return table.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)

    def ask(table: pa.Table) -> pa.Table:
        return X.ask_rows(X.chunk_of(table), np.unique(X.place(_Bytes(_parted(table)[0].column("text"), length).key, n_buckets)))

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        more = (np.bincount(which, minlength=len(every)) > 1)[which]
        ends = np.cumsum([len(k) for k in keys])
        return X.reply_rows(table, [np.packbits(more[e - len(k) : e]).tobytes() for k, e in zip(keys, ends)])

    def rows(table: pa.Table, b: _Bytes, gone: np.ndarray, text: list | None, marks: list | None, kept: bool) -> pa.Table:
        n = len(b.offsets) - 1
        edge = np.zeros(len(gone) + 1, dtype=bool)
        edge[b.offsets] = True
        begin = gone.copy()
        begin[1:] &= ~gone[:-1] | edge[1:-1]
        total = np.r_[0, np.cumsum(gone)]
        stays = b.data[~gone]
        at = b.offsets - total[b.offsets]
        view = memoryview(stays)
        return pa.table({
            "doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(b.offsets), pa.int64()), "n_removed": pa.array(np.diff(total[b.offsets]), pa.int64()),
            "n_spans": pa.array(np.diff(np.r_[0, np.cumsum(begin)][b.offsets]), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:])], pa.string()),
            "kept_text": pa.array([bytes(view[x:y]).decode("utf-8", "replace") if kept else None for x, y in zip(at[:-1], at[1:])], pa.string()),
            "chunk": table.column("chunk"), "text": pa.array(text or [None] * n, pa.string()), "marks": pa.array(marks or [None] * n, pa.binary()),
        })

    def empty(columns: list[str]) -> pa.Table:
        return pa.table({c: pa.array([], mid[c]) for c in columns})

    def sift(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Documents without a gram that another document has are done."""
        if not table.num_rows:
            return empty(list(mid))
        table, copies = _parted(table)
        whole = _Bytes(copies.column("text"), length)
        whole_rows = rows(copies, whole, np.ones(len(whole.data), bool), None, None, with_text)
        b = _Bytes(table.column("text"), length)
        every, which = np.unique(X.place(b.key, n_buckets), return_inverse=True)
        low, high = np.full(len(every), 2**62), np.full(len(every), -1)
        np.minimum.at(low, which, b.owner)
        np.maximum.at(high, which, b.owner)
        mark = (X.read_bits(replies, every) | (low < high))[which] if len(every) else np.zeros(0, bool)
        first = np.searchsorted(b.owner, np.arange(len(b.offsets)))
        texts = table.column("text").to_pylist()
        marks = [np.packbits(mark[x:y]).tobytes() if mark[x:y].any() else None for x, y in zip(first[:-1], first[1:])]
        return pa.concat_tables([rows(table, b, np.zeros(len(b.data), bool), [None if m is None else t for t, m in zip(texts, marks)], marks, with_text), whole_rows])

    stored = materialize(X.exchange(dealt, ask, answer, sift, mid_schema), "grams")
    open_ = X.deal(stored.where("marks IS NOT NULL").select("doc_id", "chunk", "text", "marks"))

    def pieces(table: pa.Table):
        """Marked pieces; of each distinct one (by shard): index, least id, and the number of each marked piece's."""
        b = _Bytes(table.column("text"), length)
        first = np.searchsorted(b.owner, np.arange(len(b.offsets)))
        bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=int(y - x)) for m, x, y in zip(table.column("marks").to_pylist(), first[:-1], first[1:])]
        at = np.flatnonzero(np.concatenate(bits))
        start, stop = b.start[at], b.stop[at]
        offset = (b.gram_at[at] - start).astype(np.uint64)
        one, number = B.distinct(B.FIRST.pieces(b.data, start, stop) + B.mix(offset), B.SECOND.pieces(b.data, start, stop))
        least = np.full(len(one), NO_ID)
        ids = ids_of(table)
        np.minimum.at(least, number, ids[b.owner[at]])
        bucket = ((b.key[at][one] >> U(32)) % U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        which, edge = np.unique(bucket[order], return_index=True)
        return b, at, one, number, least, ids, order, which, np.r_[edge, len(order)]

    def ask_pieces(table: pa.Table) -> pa.Table:
        b, at, one, _, least, _, order, which, edge = pieces(table)
        heads, blobs = [], []
        for x, y in zip(edge[:-1], edge[1:]):
            own = order[x:y]
            start, stop = b.start[at[one[own]]], b.stop[at[one[own]]]
            head = np.empty(len(own), HEAD)
            head["size"], head["at"], head["least"] = stop - start, b.gram_at[at[one[own]]] - start, least[own]
            heads.append(head.tobytes())
            blobs.append(b.data[B.ragged(start, stop - start)].tobytes())
        return pa.table({"chunk": pa.array(np.full(len(which), X.chunk_of(table), np.int32)), "bucket": pa.array(which.astype(np.int32)), "keys": pa.array(heads, pa.binary()), "extra": pa.array(blobs, pa.binary())})

    def answer_pieces(table: pa.Table) -> pa.Table:
        """For each window of each piece a bit: a document smaller than the least of the piece in its chunk has it."""
        heads = [np.frombuffer(k, HEAD) for k in table.column("keys").to_pylist()]
        head = np.concatenate(heads)
        data = np.frombuffer(b"".join(table.column("extra").to_pylist()), np.uint8)
        size = head["size"].astype(np.int64)
        start = np.cumsum(size) - size
        one, number = B.distinct(B.FIRST.pieces(data, start, start + size) + B.mix(head["at"].astype(np.uint64)), B.SECOND.pieces(data, start, start + size))
        least = np.full(len(one), NO_ID)
        np.minimum.at(least, number, head["least"])
        gram = start[one] + head["at"][one]
        width = min(GRAM, length)
        _, kind, times = np.unique(B.SECOND.pieces(data, gram, gram + width), return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(times[kind] > 1)  # distinct pieces around one gram: some of their windows may be equal
        windows = size[one] - length + 1
        begin = np.cumsum(windows) - windows
        found = np.repeat(least, windows)
        # gram after gram, in shares of some thousand pieces: windows that are equal have one gram
        mixed = mixed[np.argsort(kind[mixed], kind="stable")]
        for own in shares(mixed, kind[mixed], size[one[mixed]] + 1):
            span = size[one[own]] + 1
            end = np.cumsum(span) - 1
            symbols = np.empty(int(span.sum()), np.int64)
            inner = np.ones(len(symbols), bool)
            inner[end] = False
            symbols[inner] = data[B.ragged(start[one[own]], span - 1)]
            symbols[end] = 256 + np.arange(len(own))
            sa, bound = expand(symbols, 256, length)
            piece = np.repeat(np.arange(len(own)), span)
            within = np.arange(len(symbols)) - (end - span + 1)[piece]
            valid = within <= (span - 1 - length)[piece]
            value = np.where(valid, least[own][piece], NO_ID)[sa]
            top = np.flatnonzero(bound)
            best = np.minimum.reduceat(value, top)[np.cumsum(bound) - 1]
            ok = valid[sa]
            found[(begin[own][piece] + within)[sa[ok]]] = best[ok]
        # back to the pieces as they were asked for
        ask_windows = windows[number]
        bits = found[B.ragged(begin[number], ask_windows)] < np.repeat(head["least"], ask_windows)
        edge = np.r_[0, np.cumsum(ask_windows)]
        ends = np.cumsum([len(h) for h in heads])
        return X.reply_rows(table, [np.packbits(bits[edge[e - len(h)] : edge[e]]).tobytes() for h, e in zip(heads, ends)])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty(done)
        b, at, one, number, least, ids, order, which, edge = pieces(table)
        size = b.stop[at[one]] - b.start[at[one]] - length + 1
        begin = np.empty(len(one), np.int64)
        place = {}
        total = 0
        for bucket, x, y in zip(which, edge[:-1], edge[1:]):
            own = size[order[x:y]]
            begin[order[x:y]] = total + np.cumsum(own) - own
            place[int(bucket)] = (total, total + int(own.sum()))
            total += int(own.sum())
        smaller = np.zeros(total, bool)
        for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
            x, y = place[bucket]
            smaller[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).view(bool)
        windows = size[number]
        hit = smaller[B.ragged(begin[number], windows)] | np.repeat(ids[b.owner[at]] > least[number], windows)
        mark = np.zeros(len(b.data), bool)
        mark[B.ragged(b.start[at], windows)[hit]] = True
        return rows(table, b, B.covered(mark, length, len(mark)), None, None, with_text).select(done)

    out_schema = ", ".join(c for c in mid_schema.split(", ") if c.split()[0] in done)
    return stored.where("marks IS NULL").select(*done).unionByName(X.exchange(open_, ask_pieces, answer_pieces, finish, out_schema))
