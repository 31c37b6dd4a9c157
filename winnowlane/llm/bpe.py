"""BPE encoding and decoding with a public vocabulary file.

Encoding equals the tokenizers library's, default settings. Text between ASCII white space is
handled once for each distinct word of a batch. Unsplit text (one pre-token) longer than ``leaf``
characters is encoded by tree concatenation: leaves first, then pairs of neighbours are joined,
re-encoding a growing window around the join until its first and last token are those that both
sides already had. A sequence in which every neighbouring pair of tokens re-encodes to itself is
the BPE encoding, and pairs outside the window have not changed; so the join is exact. Leaves and
windows of one level go to a pool of THREADS threads.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from winnowlane.llm import _bytes as B

#: Characters of a pre-token up to which it is encoded at once.
LEAF = 256
#: Threads that encode the parts of one long pre-token.
THREADS = 4
#: Bytes of text handled at once.
BATCH_BYTES = 1_500_000
#: Words and pre-tokens whose ids a worker keeps; beyond it, it starts anew.
KNOWN = 60_000
#: Precomposed Latin text, which NFC leaves alone and whose lower case is of one character each.
PLAIN = re.compile("[\\x21-\\x7e\u00a1-\u012f\u0131-\u017f]+")
#: The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1
#: stands for itself, and the rest, in order, for the characters from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = [chr(b) if b in _PRINTED else chr(0x100 + [x for x in range(256) if x not in _PRINTED].index(b)) for b in range(256)]


class Codec:
    """A tokenizers BPE file, with tree concatenation for long pre-tokens."""

    def __init__(self, path: str, leaf: int = LEAF, threads: int = THREADS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.leaf, self.threads = Tokenizer.from_file(path), max(2, leaf), threads
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("the file must hold a BPE model without decoder and post-processor")
        self.suffix, self.path, self._inner = model.get("end_of_word_suffix"), path, None
        #: Merges of a text that ends a pre-token; inner() is for text that does not.
        self.last = self.whole.model
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.names = [(self.whole.id_to_token(i) or "").encode() for i in range(max(self.whole.get_vocab().values()) + 1)]
        self.known: dict[str, tuple[int, ...]] = {}
        self.seen: dict[str, tuple[int, bytes, bytes]] = {}
        shape = (spec.get("normalizer"), spec.get("pre_tokenizer"))
        del spec["model"]
        found = re.search(r"'s\|.*\+", json.dumps(shape[1])) and shape[1]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain = PLAIN if found and [n["type"] for n in shape[0]["normalizers"]] == ["NFC", "Replace", "Lowercase"] else None
        self.split = regex.compile(found) if found else None

    def inner(self):
        """The model without the mark of a word's end, made when the first long pre-token comes."""
        if self._inner is None:
            from tokenizers import models

            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            kept = {k: v for k in ("unk_token", "continuing_subword_prefix", "fuse_unk") if (v := model.get(k))}
            self._inner = models.BPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], **kept) if self.suffix else self.last
        return self._inner

    def pieces(self, text: str) -> list[tuple[int | None, str]]:
        """Special tokens' ids and pre-tokens, in order."""
        out: list[tuple[int | None, str]] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append((self.special[part], ""))
            elif part:
                if self.whole.normalizer is not None:
                    part = self.whole.normalizer.normalize_str(part)
                out += [(None, p) for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _merge(self, text: str, final: bool) -> list[tuple[int, int]]:
        """(id, characters) of each token of a fragment; ``final``: it ends the pre-token."""
        out = [(t.id, len(t.value)) for t in (self.last if final else self.inner()).tokenize(text)]
        if final and self.suffix and out:
            out[-1] = (out[-1][0], out[-1][1] - len(self.suffix))
        return out

    def tree(self, text: str) -> list[int]:
        """Ids of one pre-token by tree concatenation."""
        if len(text) <= self.leaf:
            return [i for i, _ in self._merge(text, True)]
        cuts = list(range(0, len(text), self.leaf // 2 or 1))
        spans = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(text)])]
        with ThreadPoolExecutor(self.threads) as pool:
            parts = list(pool.map(lambda s: self._merge(text[s[0] : s[1]], s[1] == len(text)), spans))
            while len(parts) > 1:
                pairs = [(parts[i], parts[i + 1], spans[i][0], spans[i + 1][0], spans[i + 1][1]) for i in range(0, len(parts) - 1, 2)]
                joined = list(pool.map(lambda p: self._join(text, *p), pairs))
                parts = joined + parts[2 * len(pairs) :]
                spans = [(spans[2 * i][0], spans[2 * i + 1][1]) for i in range(len(pairs))] + spans[2 * len(pairs) :]
        return [i for i, _ in parts[0]]

    def _join(self, text: str, left: list, right: list, start: int, middle: int, end: int) -> list:
        k = 2
        while True:
            all_left, all_right = k >= len(left), k >= len(right)
            a = left if all_left else left[-k:]
            b = right if all_right else right[:k]
            lo, hi = middle - sum(n for _, n in a), middle + sum(n for _, n in b)
            window = self._merge(text[lo:hi], hi == len(text))
            if (all_left or window[0] == a[0]) and (all_right or window[-1] == b[-1]):
                return (left[:-k] if not all_left else []) + window + (right[k:] if not all_right else [])
            k *= 2

    def encode_word(self, word: str) -> list[int]:
        """Ids of text without ASCII white space, however long."""
        out: list[int] = []
        for special, piece in self.pieces(word):
            out += [special] if special is not None else self.tree(piece)
        return out

    def _simple(self, word: str) -> tuple[int, ...]:
        """Ids of a word of plain Latin letters, digits and signs, a pre-token at a time."""
        out: list[int] = []
        for piece in self.split.findall(word.lower()):
            ids = self.known.get(piece)
            if ids is None:
                ids = tuple(t.id for t in self.last.tokenize("".join(map(BYTE_CHARS.__getitem__, piece.encode()))))
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[piece] = ids
            out += ids
        return tuple(out)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each of many words without ASCII white space.

        Plain Latin text needs no normalisation but lower case, so its pre-tokens are looked up;
        long text goes by tree concatenation; all else goes to the library.
        """
        got: list = [None] * len(words)
        rest: list[int] = []
        plain, leaf = self.plain and self.plain.fullmatch, self.leaf
        for i, w in enumerate(words):
            if len(w) > leaf:
                got[i] = tuple(self.encode_word(w))
            elif plain and plain(w) and "<|" not in w:
                got[i] = self._simple(w)
            else:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.whole.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
                got[i] = tuple(e.ids)
        return got

    def encode(self, text: str) -> list[int]:
        return [i for w in re.findall(r"[^\x20\x09-\x0D]+", text) for i in self.encode_word(w)]

    def units(self, texts) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """Ids of the distinct words; the number of each word's entry; the index of each text's first word."""
        data, offsets = B.text_buffer(texts)
        starts, ends, first = B.word_bounds(data, offsets)
        if not len(starts):
            return [], np.zeros(0, np.int32), first
        which, inverse = B.distinct_words(data, starts, ends)
        return self.encode_words(B.slices(data, starts[which], ends[which]).to_pylist()), inverse, first

    def encode_column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, and the bounds of each text's ids."""
        got, inverse, first = self.units(texts)
        counts = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((x for t in got for x in t), np.uint32, int(counts.sum()))
        begin = np.cumsum(counts) - counts
        return ids[B.ragged(begin[inverse], counts[inverse])], np.r_[0, np.cumsum(counts[inverse])][first]

    def decode(self, ids) -> bytes:
        """UTF-8 of the decoded ids: without a decoder the library puts one space between tokens."""
        return b" ".join([self.names[i] for i in ids])

    def digests(self, texts) -> tuple[np.ndarray, list[str], list[str]]:
        """Number of ids, SHA-256 of the ids and of the decoded text, for each text."""
        counts, parts = self.coded(texts)
        hexes: tuple[list[str], list[str]] = ([], [])
        for ids, said in parts:
            hexes[0].append(hashlib.sha256(ids).hexdigest())
            hexes[1].append(hashlib.sha256(said).hexdigest())
        return counts, *hexes

    def coded(self, texts) -> tuple[np.ndarray, Iterator[tuple[bytes, bytes]]]:
        """Number of ids of each text; then its ids as little-endian 32-bit integers, and UTF-8 of the decoded text."""
        data, offsets = B.text_buffer(texts)
        starts, ends, first = B.word_bounds(data, offsets)
        which, inverse = B.distinct_words(data, starts, ends) if len(starts) else (starts, starts)
        words = B.slices(data, starts[which], ends[which]).to_pylist()
        seen = self.seen
        if len(seen) > KNOWN:
            seen.clear()
        new = [w for w in words if w not in seen]
        seen.update((w, (len(t), array("I", t).tobytes(), self.decode(t))) for w, t in zip(new, self.encode_words(new)))
        rows = [seen[w] for w in words]
        counts = np.fromiter([r[0] for r in rows], np.int64, len(rows))
        coded, said = np.empty(len(rows), object), np.empty(len(rows), object)
        coded[:], said[:] = [r[1] for r in rows], [r[2] for r in rows]
        here = counts[inverse]
        total = np.r_[0, np.cumsum(here)]

        def each() -> Iterator[tuple[bytes, bytes]]:
            for a, b in zip(first[:-1], first[1:]):
                own = inverse[a:b]
                ids = b"".join(coded[own].tolist())
                if not (some := here[a:b] > 0).all():
                    own = own[some]
                yield ids, b" ".join(said[own].tolist())

        return total[first[1:]] - total[first[:-1]], each()


@lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    return Codec(path, leaf)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that their texts are of about ``limit`` bytes; one text may be larger."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = B.text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Token count and digests of ids and decoded text of each whole text.

    A null or empty text has no ids and decodes to an empty string. Rows that repeat an id stay
    apart; other columns are not looked at. No row leaves the partition it is read in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf)
        for batch in text_batches(batches, "text"):
            n, ids, said = c.digests(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(said, pa.string())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """All columns of docs, and token_ids (array of int), n_tokens and decoded.

    A null or empty text has no ids and decodes to an empty string; a text is encoded whole however long it is. Rows that
    repeat an id or a text stay apart. An empty table gives no rows. The new names must be free: where they are not, an
    error is raised before any row is read.
    """
    from pyspark.sql import types as T

    new = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    if clash := {f.name for f in new} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf)
        for batch in text_batches(batches, text_col):
            n, parts = c.coded(batch.column(text_col))
            ids, said = zip(*parts)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(n, pa.int64()), pa.array([x.decode() for x in said], pa.string())], [*batch.schema.names, *(f.name for f in new)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def decode(frame: DataFrame, path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All columns and the decoded text of an array of ids; null ids decode to an empty string."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = pa.array([c.decode(r or ()).decode() for r in batch.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(out, T.StringType())]))
