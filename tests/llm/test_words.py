"""Words made to collide in an earlier hash, through every operator that tells words by hashes; links that don't depend on how sets are sent."""

import hashlib
import random
import re

import numpy as np
import pytest

WORD = r"[^\x20\x09-\x0D]+"
STEP = 0xD6E8FEB86659FD93


def twins():
    """Pairs of words whose padded first eight bytes differ by an xor of products of their lengths, the longer one ending in NUL."""
    out = [(b"\x01\x01\x01\x40\xc2\x80\x01\x01abcde", b"\x7c\x3f\x7b\xea\x8a\x81\x68\x28abcde\0")]
    for short in range(9, 16):
        for long_ in range(short + 1, 17):
            x = (short * STEP ^ long_ * STEP) % 2**64
            first = b"qwertyui"
            other = (int.from_bytes(first, "little") ^ x).to_bytes(8, "little")
            tail = b"z" * (short - 8)
            out.append((first + tail, other + tail + b"\0" * (long_ - short)))
    out += [(b"a", b"a\0"), (b"a\0", b"a\0\0"), (b"\0", b"\0\0"), (b"b" * 16, b"b" * 16 + b"\0"), (b"b" * 15, b"b" * 15 + b"\0")]
    return out


def test_hashes_of_words_that_end_in_nul():
    from winnowlane.llm import _bytes as B

    words = sorted({w for pair in twins() for w in pair})
    at = np.cumsum([0] + [len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    for half in B.word_pairs(data, at[:-1], at[1:]):
        assert len(set(half.tolist())) == len(words)
    # alone at the very end and the very start of a buffer, and no word at all
    for w in words:
        alone = np.frombuffer(w, np.uint8)
        inside = np.frombuffer(b"x" + w + b"\0\0y", np.uint8)
        one, other = B.word_pairs(alone, np.array([0]), np.array([len(w)])), B.word_pairs(inside, np.array([1]), np.array([1 + len(w)]))
        assert [x.tolist() for x in one] == [x.tolist() for x in other]
    assert len(B.word_pairs(data, np.array([0]), np.array([0]))[0]) == 1


@pytest.fixture(scope="module")
def pairs():
    found = []
    for a, b in twins():
        try:
            a, b = a.decode(), b.decode()
        except UnicodeDecodeError:
            continue
        if all(len(re.findall(WORD, w)) == 1 for w in (a, b)):
            found.append((a, b))
    return found


def test_operators_tell_such_words_apart(spark, pairs):
    from winnowlane.llm import anchors, imatch, ngram_join

    assert len(pairs) >= 5
    rest = [" ".join(f"v{k}" for k in range(20)), " ".join(f"u{k}" for k in range(20))]
    for w in pairs:
        long_ = [(i, f"{rest[0]} {x} {rest[1]}") for i, x in enumerate(w)]
        out = anchors.remove_repeats(spark.createDataFrame(long_, "doc_id long, text string")).collect()
        assert [r.n_removed for r in out] == [0, 0] and {r.kept_sha256 for r in out} == {hashlib.sha256(t.encode()).hexdigest() for _, t in long_}
    alone = [(i, x) for i, x in enumerate(x for w in pairs for x in w)]
    alone = [(i, x) for i, x in alone if x not in [y for _, y in alone[:i]]]
    frame = spark.createDataFrame(alone, "doc_id long, text string")
    assert all(r.n_links == 0 for r in ngram_join.link(frame).collect())
    assert ngram_join.keep_one(frame).count() == len(alone)
    assert len({r.fingerprint for r in imatch.fingerprint(frame, least_docs=1).collect()}) == len(alone)


def test_links_are_those_that_share_a_band_however_they_are_sent(spark):
    """At a miss of 0.3 many alike pairs share no band: no way of sending may find them."""
    from winnowlane.llm import _blocks, ngram_join

    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts = sorted(set(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import pyarrow as pa

    bands = ngram_join.bands_for(0.8, miss=0.3)
    sets = ngram_join.shingle_sets(pa.array(texts))
    codes = ngram_join.signatures(sets, bands).view(np.int64) & ~_blocks.NUMBERS
    alike = np.array([[len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8 for y in sets] for x in sets])
    met = (codes[:, None, :] == codes[None, :, :]).any(axis=2)
    want = (alike & met).sum(axis=1) - 1
    assert (alike & ~met).any()
    for whole, block in ((10**9, 512), (10**9, 7), (2, 512), (2, 7)):
        got = {r.doc_id: r.n_links for r in ngram_join.link(frame, miss=0.3, whole=whole, block=block).collect()}
        assert got == dict(enumerate(want.tolist())), (whole, block)
