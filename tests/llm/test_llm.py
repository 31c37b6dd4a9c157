"""Operators on small tables with nulls, empty, long, tied and repeated rows, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 6))) for _ in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    shared = prose(rng, 60)
    texts = [prose(rng, rng.randint(40, 200)) for _ in range(30)]
    texts += [f"{prose(rng, 50)} {shared} {prose(rng, 20)}" for _ in range(6)] + [texts[0]] * 3
    near = texts[1].split()
    for k in (5, 60):
        near[k % len(near)] = "changed"
        texts.append(" ".join(near))
    texts += ["", None, "one", "two words", " \t\n ", "a" * 3000, "x " * 400, prose(rng, 20000)]
    return [(i * 3, t, "en" if i % 2 else None, None if i % 7 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # clashing names of the operators' own columns must do no harm
    return spark.createDataFrame(corpus, SCHEMA).withColumn("chunk", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("marks", F.lit(None).cast("string")).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, t or "")


def test_anchors(docs, corpus, empty):
    from winnowlane.llm import anchors

    c = Counter()
    for _, t, *_ in corpus:
        w = words(t)
        c.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = {r.doc_id: r for r in anchors.remove_repeats(docs, with_text=True).collect()}
    assert len(out) == len(corpus)
    for i, t, *_ in corpus:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if c[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (out[i].n_words, out[i].n_removed, out[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert anchors.remove_repeats(empty).count() == 0


def test_suffix(docs, corpus, empty):
    from winnowlane.llm import suffix

    out = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    seen = set()
    for i, t, *_ in corpus:
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, s in enumerate(own):
            if s in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_repeated_and_null_ids(spark):
    from winnowlane.llm import suffix

    t = "The same sentence, long enough to be found once more, stands here."
    rows = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_removed) for r in suffix.remove_repeats(rows).collect())
    assert [n for _, n in got] == [0, 0, len(t), len(t)]


def test_expand_equals_sorted_suffixes():
    from winnowlane.llm.suffix import expand

    rng = np.random.default_rng(2)
    pieces = [rng.integers(97, 100, rng.integers(5, 40)) for _ in range(30)]
    s = np.concatenate([np.r_[p, 256 + k] for k, p in enumerate(pieces)])
    rows, bound = expand(s, 256, 6)
    cut = lambda i: tuple(s[i : i + 6]) if not (s[i : i + 6] >= 256).any() and i + 6 <= len(s) else (i,)
    for a, b, new in zip(rows[:-1], rows[1:], bound[1:]):
        assert new == (cut(a) != cut(b))


def test_imatch(docs, corpus, empty):
    from winnowlane.llm import imatch

    out = {r.doc_id: r for r in imatch.fingerprint(docs).collect()}
    rows = sorted(corpus)
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        assert out[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest() and out[i].n_chars == len(t)
        assert 0 <= out[i].near_edited <= 1 and bool(out[i].fingerprint) == bool(words(t))
        assert out[i].near_next == np.mean([a == b for a, b in zip(re.findall("." * 8, out[i].fingerprint.ljust(256, "-")), re.findall("." * 8, out[rows[(k + 1) % len(rows)][0]].fingerprint.ljust(256, "-")))])
    assert len({out[i].fingerprint for i, t, *_ in corpus if t == corpus[0][1]}) == 1
    assert imatch.fingerprint(empty).count() == 0


def group(ids, edges):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in ids}


def test_ngram_join(docs, corpus, empty):
    from winnowlane.llm import ngram_join

    sets = {}
    for i, t, *_ in corpus:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    n, c = Counter(x for e in edges for x in e), group(sets, edges)
    for block in (512, 2):  # the second deals every group into several blocks
        out = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.link(docs, block=block).collect()}
        assert out == {i: (c[i], n[i]) for i in sets} and edges
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(c.values())
    assert ngram_join.link(empty).count() == 0


def test_embeddings(spark):
    from winnowlane.llm import embedding_dedup

    rng = np.random.default_rng(4)
    rows = []
    for g in range(25):
        v = rng.standard_normal(64)
        for k in range(rng.integers(1, 6)):
            rows.append([len(rows), (v + rng.standard_normal(64) * 0.15 * k / 5).tolist(), int(g % 3)])
    rows += [[len(rows) + k, rows[0][1], rows[0][2]] for k in range(4)]
    rows += [[500, None, 1], [501, [0.0] * 64, 1], [502, [float("nan")] + [1.0] * 63, 1], [503, rows[0][1], None], [504, [1.0, None], 1], [505, [], 1], [506, [float("inf")] * 3, 1], [507, rows[0][1], rows[0][2] + 1]]
    ok = [r for r in rows if r[0] < 500 or r[0] == 507]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    edges = [(ok[a][0], ok[b][0]) for a in range(len(ok)) for b in range(a) if near[a, b] and ok[a][2] == ok[b][2]]
    n, c = Counter(v for e in edges for v in e), group([r[0] for r in rows], edges)
    f = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(0))
    for block in (1024, 2):
        out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(f, block=block).collect()}
        assert out == {r[0]: (n[r[0]], c[r[0]], c[r[0]] == r[0]) for r in rows} and edges
    assert embedding_dedup.link(f.limit(0)).count() == 0


def test_components(spark):
    from winnowlane.llm._components import components

    edges = [(k, k + 1) for k in range(100, 140)] + [(1, 900), (900, 2), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = group({x for e in edges for x in e} - {7}, [e for e in edges if e != (7, 7)])
    assert got == want


def test_mixing(spark, docs, corpus, empty):
    from winnowlane.llm import mixing

    out = {r.doc_id: r for r in mixing.plan(docs).collect()}
    size, own = Counter(), {}
    for i, t, _, s in corpus:
        size[s] += len(words(t))
        own[i] = (len(words(t)), s)
    order = sorted((s for s in size if s is not None)) + [None]
    left, open_ = 1.5 * sum(size.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    while True:  # as the contract words it: share by weight, cap, share the excess anew
        share = left / sum(open_.values())
        full = [s for s, w in open_.items() if share * w > 2 * size[s]]
        if not full:
            target |= {s: share * w for s, w in open_.items()}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            del open_[s]
    taken = Counter()
    for i, (n, s) in own.items():
        assert out[i].size == n and out[i].source_size == size[s] and math.isclose(out[i].target, target[s])
        assert out[i].taken in (0, n, 2 * n)
        taken[s] += out[i].taken
    most = {s: max(n for n, x in own.values() if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= most[s] for s in order)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(times[i] == out[i].taken // n for i, (n, _) in own.items() if n) and max(times.values()) <= 2
    assert mixing.plan(empty).count() == 0
    assert {r.taken for r in mixing.plan(docs).select("doc_id", "taken").exceptAll(mixing.plan(docs).select("doc_id", "taken")).collect()} == set()


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        s = sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_disclosure_base(spark):
    from winnowlane.llm import disclosure

    rng = random.Random(9)
    parts = ["a@b.c", "a@b.c_d@e.f.g", "x@y", "é@b.co", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49((((", "+1..2", "++44 20 7946 0958.", "😀", "word", "12", "-", "\n", "@", "."]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "9" * 20000), (903, "a" * 20000 + "@"), (904, "1 " * 9000), (905, "a.b@" * 3000)]
    out = {r.doc_id: r for r in disclosure.report(spark.createDataFrame(rows, "doc_id long, text string"), support=10**6).collect()}
    for i, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in PII.items() if i < 902 or k != "x" for m in re.finditer(p, t or "") if valid(k, m.group())] if i != 903 else []
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert out[i].spans == want and out[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone) == tuple(sum(k == x for x, *_ in spans) for k in PII)


def test_disclosure_of_terms(spark):
    from winnowlane.llm import disclosure

    rng = random.Random(3)
    rows = [(i, prose(rng, 30) + " common", None) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 10)} Zyxwold wrote from z@x.org, common {'77001' if i < 4 else ''}", 5) for i in range(4)]
    rows += [(200, None, 1), (201, "", 0), (202, "Zyxwold alone", 3)]
    f = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: r.spans for r in disclosure.report(f).collect()}
    for i, t, _ in rows:
        if 100 <= i < 200:
            got = {t[int(a) : int(b)] for k, a, b in (s.split(":") for s in out[i].split(",")) if k == "term"}
            assert {"Zyxwold", "77001", "wrote"} <= got and "common" not in got and out[i].startswith("email:")
        else:
            assert out[i] == ""
    clean = {r.doc_id: r for r in disclosure.sanitise(f).collect()}
    assert "<TERM>" in clean[100].text and "<EMAIL>" in clean[100].text and "<NUMBER>" in clean[100].text and "z@x" not in clean[100].text
    assert clean[100].n_chars == len(clean[100].text) and clean[202].text == "Zyxwold alone" and clean[200].text is None and clean[5].text == rows[5][1]
    assert disclosure.report(f.limit(0)).count() == 0


def test_rollup(spark, docs, corpus, tmp_path):
    from winnowlane.llm import rollup

    state = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    counts = {"words-1": rollup.word_tokens(F.col("text")), "bytes-1": rollup.byte_tokens(F.col("text"))}
    assert state.totals().count() == 0
    assert state.commit("a", rollup.inserts(docs, counts)) and not state.commit("a", rollup.inserts(docs, counts))
    gone = docs.where("doc_id < 30")
    state.commit("b", rollup.deletes(gone, counts))
    want = Counter()
    for i, t, lang, s in corpus:
        if i >= 30:
            want[s, lang, "words-1"] += len(words(t))
            want[s, lang, "bytes-1"] += len((t or "").encode())
    got = {(r.source, r.lang, r.tokenizer_version): r.n_tokens for r in state.totals().collect()}
    assert got == dict(want)
    state.commit("c", rollup.revisions(docs.where("doc_id >= 30"), {"words-1": counts["words-1"]}, {"words-2": rollup.letter_tokens(F.col("text"))}))
    assert {r.tokenizer_version for r in state.totals().collect()} == {"words-2", "bytes-1"}
    with pytest.raises(ValueError):
        state.commit("a/b", rollup.inserts(docs, counts))


def test_bpe(spark, docs, corpus, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from winnowlane.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(8)
    hard = ["".join(rng.choice("etaoin") for _ in range(5000)), "ffi" * 700 + "é" * 900, "!" * 3000, "<|endoftext|>x<|startoftext|>", "don't IT'S 12½ ² ΑΣ. 中文 🎉 ſß", "   a b", None, ""]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    for leaf in (256, 8):
        out = {r.doc_id: r for r in bpe.encode_digest(docs.select("doc_id", "text").unionByName(more), path, leaf=leaf).collect()}
        for i, t in [(r[0], r[1]) for r in corpus] + [(10**6 + i, t) for i, t in enumerate(hard)]:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), i
            assert out[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode(docs, path)
    assert bpe.decode(full, path, out="again").where("again != decoded").count() == 0
    assert bpe.encode_digest(empty, path).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(full, path)


def test_toxicity(spark, empty):
    from winnowlane.llm import toxicity

    rng = random.Random(6)
    rows, marks = [], []
    for i in range(800):
        bad = i % 8 == 0
        w = prose(rng, rng.randint(5, 60)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "zorgblat", "zorgwump", "zorgnix"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    rows += [(10**6, None), (10**6 + 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    g = toxicity.fit(docs, labels)
    assert "zorg" in g.stems
    out = {r.doc_id: r for r in toxicity.score(docs, g).select("doc_id", "score", toxicity.held_out().alias("h")).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    held = [(out[i].score >= 0.5, bool(t)) for i, t in marks if out[i].h]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert out[10**6].score == out[10**6 + 1].score < 0.5
    clean = toxicity.keep_clean(docs, g)
    assert clean.columns == docs.columns and clean.count() == sum(r.score < 0.5 for r in out.values())
    assert toxicity.fit(docs, labels.limit(0)).stems == {} and toxicity.score(empty, g).count() == 0
    kinds = [k for k, _ in g.clauses("You are an idiot. He is not an idiot! She said idiot")]
    assert kinds == ["aimed insult", "negated insult", "reported insult"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(8, 80)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, rows[3][1], "en", "s1"), (101, "you idiot and moron", "en", "s0"), (102, f"{prose(rng, 9)} mail q@r.org", None, None), (103, None, None, None), (104, "", "en", "s2")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i == 101)) for i, *_ in rows], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # brute force: what each stage must have done, on the ids and words it leaves
    times = Counter(r.doc_id for r in out)
    assert 101 not in times and 100 not in times and max(times.values()) <= 2
    by = {r.doc_id: r for r in out}
    assert all(by[i].text == t for i, t, *_ in rows if i in by and i < 40)
    if 102 in by:
        assert "<EMAIL>" in by[102].text
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "personal data", "mixing", "tokens"]
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(r.token_ids == lib.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.token_ids) for r in out)
