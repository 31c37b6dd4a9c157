"""Operators do the whole job: no entity, term or row is left out for being rare or short."""

import math
import random
import re
from collections import Counter


def marked(text, spans):
    return {text[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in spans.split(",") if s) if k == "term"}


def test_disclosure_of_rare_entities(spark):
    from winnowlane.llm import disclosure

    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(200)]
    texts[0] += " Brixelon has once@mail.example"
    texts[1] += " Tandorre has twice@mail.example"
    texts[2] += " Tandorre has twice@mail.example 10.1.2.3"
    texts += [texts[2]]  # a row of its own
    rows = [(i, t) for i, t in enumerate(texts[:-1])] + [(2, texts[-1])]
    words = [set(re.findall(r"[a-z0-9]{3,}", t.lower())) for t in texts]
    held = [set(re.findall(r"\S+@\S+|10\.1\.2\.3", t)) for t in texts]
    n, n_term, n_entity = len(texts), Counter(w for x in words for w in x), Counter(e for x in held for e in x)
    both = Counter((e, w) for x, y in zip(held, words) for e in x for w in y)

    def tells(e, w):
        rate = n_entity[e] / n
        return math.log((both[e, w] + rate) / (n_term[w] + 1) / rate) >= -0.8 * math.log(rate)

    out = disclosure.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == n
    got = {r.doc_id: marked(rows[r.doc_id][1], r.spans) for r in out}
    for i, x in enumerate(held[:-1]):
        # words of the address itself are covered by its own span
        want = {w for e in x for w in words[i] if tells(e, w)} - {"once", "twice", "mail", "example"}
        assert got[i] == want, i
    assert "brixelon" in got[0] and "tandorre" in got[1] and "tandorre" in got[2]


def test_disclosure_by_short_terms(spark):
    from winnowlane.llm import disclosure

    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(100)]
    texts = [" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(100)]
    texts += [" ".join(rng.choice(vocab) for _ in range(20)) + f" {x} writes from z@x.example" for x in ("Bo", "李明", "Q") for _ in range(3)]
    out = {r.doc_id: r.spans for r in disclosure.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, x in ((100, "bo"), (103, "李明"), (106, "q")):
        assert x in marked(texts[i], out[i]), x


def test_imatch_asks_for_every_term(spark):
    from winnowlane.llm import imatch

    # of each text only the word it shares with its neighbour lies in the band
    rows = [(i, f"common pair{i // 2} single{i}") for i in range(80)]
    out = {r.doc_id: r for r in imatch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(0, 80, 2):
        assert out[i].fingerprint == out[i + 1].fingerprint and out[i].near_next == 1, i
    assert len({r.fingerprint for r in out.values()}) == 40


def test_toxicity_keeps_every_significant_word(spark):
    from winnowlane.llm import toxicity

    letters = "abcdefghijklmnopqrstuvwxyz"
    learned = [f"zx{a}{b}{c}" for a in letters for b in letters for c in letters[:8]]
    bad = " ".join(learned)
    rows = [(i, bad if i % 12 == 0 else "plain words of prose", int(i % 12 == 0)) for i in range(360)]
    f = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(f.select("doc_id", "text"), f.select("doc_id", "toxic"))
    assert len(learned) > 5000 and set(learned) <= set(grammar.insults)
