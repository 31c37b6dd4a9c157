"""Disclosing terms of documents with very many entities and very many terms, and by classes against pairs."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F


def wanted(texts, elsewhere, threshold=0.8):
    """Terms marked in each text, pair by pair."""
    words = [{w.lower() for w in re.findall(r"[^\W_]+", t)} for t in texts]
    held = [set(re.findall(r"[a-z0-9]+@[a-z0-9]+\.[a-z]+", t)) for t in texts]
    n, n_term, n_ent = len(texts), Counter(w for x in words for w in x), Counter(e for x in held for e in x)
    both = Counter((e, w) for x, y in zip(held, words) for e in x for w in y)
    given = {p: (k + n_ent[p[0]] / n) / (n_term[p[1]] + 1) for p, k in both.items()}
    tells = {p for p, g in given.items() if n_ent[p[0]] < n and math.log(g / (n_ent[p[0]] / n)) >= -threshold * math.log(n_ent[p[0]] / n)}
    pointing = {w for e, w in tells if elsewhere is not None and given[e, w] >= elsewhere}
    return [{w for w in x if w in pointing or any((e, w) in tells for e in y)} for x, y in zip(words, held)]


@pytest.mark.parametrize("elsewhere", [None, 0.5])
def test_classes_equal_pairs(spark, elsewhere):
    from winnowlane.llm import disclosure

    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(120)] + ["the", "of"]
    texts = []
    for _ in range(150):
        t = [rng.choice(vocab[:: rng.choice([1, 3, 9])]) for _ in range(rng.randint(1, 25))] + ["the"]
        t += [f"n{rng.randrange(12)}@m{rng.randrange(3)}.org" for _ in range(rng.choice([0, 0, 1, 2, 5]))]
        texts.append(" ".join(t))
    texts += texts[:4] + [texts[0]] * 2
    frame = spark.createDataFrame([(i % 151, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    base = re.compile(r"[a-z0-9]+@[a-z0-9]+\.[a-z]+")
    want = Counter()
    for i, (t, marks) in enumerate(zip(texts, wanted(texts, elsewhere))):
        over = [m.span() for m in base.finditer(t)]
        terms = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if m.group().lower() in marks and not any(a < m.end() and m.start() < b for a, b in over)]
        want[(i % 151, ",".join([f"email:{a}:{b}" for a, b in over] + [f"term:{a}:{b}" for a, b in terms]))] += 1
    assert Counter((r.doc_id, r.spans) for r in disclosure.report(frame, elsewhere=elsewhere).collect()) == want


def test_spans_of_terms_apart_from_base_spans(spark):
    from winnowlane.llm import disclosure

    rng = random.Random(2)
    cut = lambda n: sorted({(a := rng.randrange(200), a + rng.randint(1, 12)) for _ in range(n)})
    rows = [(cut(rng.choice([0, 1, 5, 300])), cut(rng.choice([0, 1, 9, 400]))) for _ in range(30)]
    kind = "array<struct<kind:string,start:bigint,stop:bigint>>"
    frame = spark.createDataFrame([([("term", *t) for t in terms], [("ip", *b) for b in base]) for terms, base in rows], f"m {kind}, b {kind}")
    for r in frame.select("m", "b", disclosure._apart(F.col("m"), F.col("b")).alias("x")).collect():
        assert [(x.start, x.stop) for x in r.x] == sorted((m.start, m.stop) for m in r.m if not any(b.start < m.stop and m.start < b.stop for b in r.b))


def test_a_document_of_very_many_entities_and_terms(spark):
    """Work follows their sum, not their product: 3,000 of each would be nine million pairs."""
    from winnowlane.llm import disclosure

    text = " ".join(f"p{k}@mail.org word{k}" for k in range(3000))
    frame = spark.createDataFrame([(1, text)] + [(k, "plain text") for k in range(2, 200)], "doc_id long, text string")
    began = time.perf_counter()
    r = disclosure.report(frame).where("doc_id = 1").head()
    assert time.perf_counter() - began < 120
    kinds = Counter(s.split(":")[0] for s in r.spans.split(","))
    assert kinds == {"email": 3000, "term": 3000} and r.n_email == 3000
    held = disclosure.Disclosing(spark.createDataFrame([(1, text, [f"email:p{k}@mail.org" for k in range(3000)])], "row long, text string, entities array<string>"), frame, 199)
    assert held.met().count() <= 2
