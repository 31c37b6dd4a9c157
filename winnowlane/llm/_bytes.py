"""Vectorised text handling over Arrow string buffers.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]`` and never crosses a document. Words of up to 16
bytes that don't end in NUL are told by their bytes, filled with zeros, alone; a permutation of 128 bits mixes these, so
different ones never agree in both families. Longer ones and those that end in NUL take 128 bits of BLAKE2b. Windows of words or bytes are sums of their items
times powers of an odd multiplier modulo 2**64, mixed at the end, so that every window hash of a block
of documents costs a constant number of array passes; they are for windows of up to 64 items.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes hashed at once, and most bytes of a piece.
BLOCK, PIECE = 1 << 19, 512
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))


class Powers:
    """Powers of an odd multiplier modulo 2**64, extended when needed."""

    def __init__(self, base: int):
        self.base, self.known = base % 2**64, np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, 2 * len(self.known)), self.base, dtype=np.uint64)
            steps[0] = 1
            self.known = np.multiply.accumulate(steps)
        return self.known[:n]


class Family:
    """One of several independent hash families."""

    def __init__(self, seed: int, half: int):
        self.half, draw = half, stream(seed, 258)
        self.table = draw[:256].copy()
        p = (int(draw[256]) & ~7) | 5  # 5 modulo 8: the multiplicative order is as long as can be
        q = (int(draw[257]) & ~7) | 5
        self.p, self.q = Powers(p), Powers(q)
        self.p_inverse, self.q_inverse = Powers(pow(p, -1, 2**64)), Powers(pow(q, -1, 2**64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the given byte ranges; equal bytes have equal hashes wherever they stand."""
        return word_pairs(data, starts, ends)[self.half]

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of at most PIECE bytes each, from running sums.

        As all polynomials modulo a power of two, these have collisions by construction among ranges
        of 1,024 bytes and more; ranges that long are refused.
        """
        if len(starts) and int((ends - starts).max()) > PIECE:
            raise ValueError(f"a piece has at most {PIECE} bytes")
        if len(starts) > 1 and (starts[1:] < starts[:-1]).any():
            order = np.argsort(starts, kind="stable")
            out = np.empty(len(starts), dtype=np.uint64)
            out[order] = self.pieces(data, starts[order], ends[order])
            return out
        out = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(starts, low + BLOCK)))
            n = int(ends[at:to].max()) - low
            term = self.table[data[low : low + n]]
            term *= self.p(n)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(term, out=total[1:])
            begin, end = starts[at:to] - low, ends[at:to] - low
            hashed = total[end] - total[begin]
            hashed *= self.p_inverse(max(n, 1))[np.minimum(begin, max(n - 1, 0))]
            hashed += (end - begin).astype(np.uint64) * U(0x9E3779B97F4A7C15)
            out[at:to] = mix(hashed)
            at = to
        return out

    def windows(self, items: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all runs of ``width`` consecutive items; there are len(items) - width + 1."""
        n = len(items) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        total = np.zeros(len(items) + 1, dtype=np.uint64)
        np.cumsum(items * self.q(len(items)), out=total[1:])
        out = total[width:] - total[:-width]
        out *= self.q_inverse(n)
        return mix(out)

    def bytes_windows(self, data: np.ndarray, width: int) -> np.ndarray:
        return self.windows(self.table[data], width)


#: Two families: together they identify a window by 128 bits.
FIRST, SECOND = Family(0x5EED1, 0), Family(0x5EED2, 1)

#: Keys of the rounds of the permutation, and of the digest of longer words.
ROUNDS, LONG = stream(0xF0E1D2C3, 6), b"words of more than 16 bytes, or that end in NUL"
TAILS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def word_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each byte range. Ranges of up to 16 bytes that differ and don't end in NUL never have equal pairs."""
    n = len(starts)
    if not n:
        return np.zeros(0, U), np.zeros(0, U)
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    block = np.ndarray((len(data) + 9,), "<u8", padded.data, 0, (1,))
    left = block[starts] & TAILS[np.minimum(size, 8)]
    more = np.clip(size - 8, 0, 8)
    right = np.where(more > 0, block[np.minimum(starts + 8, len(data))] & TAILS[more], U(0))
    for key in ROUNDS:
        left, right = right, left ^ mix(right + key)
    # filled with zeros, words that end in NUL would look like shorter ones
    long_ = np.flatnonzero((size > 16) | ((size > 0) & (padded[np.maximum(ends, 1) - 1] == 0)))
    if len(long_):
        raw = memoryview(np.ascontiguousarray(data))
        digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16, key=LONG).digest() for a, b in zip(starts[long_].tolist(), ends[long_].tolist())])
        both = np.frombuffer(digests, "<u8").reshape(-1, 2)
        left[long_], right[long_] = both[:, 0], both[:, 1]
    return left, right


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, number: np.ndarray) -> bool:
    """Whether every range has the bytes of range ``one[number]``; a chunk of ranges at a time."""
    size = ends - starts
    if (size != size[one][number]).any():
        return False
    done = np.cumsum(size)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + BLOCK, "right")))
        like = starts[one[number[at:to]]]
        if (data[ragged(starts[at:to], size[at:to])] != data[ragged(like, size[at:to])]).any():
            return False
        at = to
    return True


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one range of each distinct content, and for each range the number of its content: by hash, and proved by comparing bytes."""
    one, number = distinct(*word_pairs(data, starts, ends))
    if same_bytes(data, starts, ends, one, number):
        return one, number
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.int32)
    return np.unique(number, return_index=True)[1], number


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8) if len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each document the index of its first word. ``between``: for each byte, whether it parts words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lens[i] - 1, for all i in order."""
    total = int(lens.sum())
    kind = np.int32 if total < 2**31 and (not len(starts) or int(starts.max()) + int(lens.max()) < 2**31) else np.int64
    first = np.cumsum(lens) - lens
    out = np.repeat((starts - first).astype(kind), lens)
    out += np.arange(total, dtype=kind)
    return out


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one item of each distinct pair, and for each item the number of its pair."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    inverse = np.empty(len(order), dtype=np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], inverse


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given byte ranges as an Arrow string array."""
    lens = ends - starts
    at = np.zeros(len(lens) + 1, dtype=np.int64)
    np.cumsum(lens, out=at[1:])
    raw = data[ragged(starts, lens)].tobytes()
    return pa.Array.from_buffers(pa.large_string(), len(lens), [None, pa.py_buffer(at), pa.py_buffer(raw)])


def covered(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in a run of ``width`` items that starts at a mark."""
    steps = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(marks)
    steps[at] += 1
    np.subtract.at(steps, np.minimum(at + width, n), 1)
    return np.cumsum(steps[:n]) > 0
