"""Crafted texts, repeated rows and both sides of every size switch, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def twins(n, a="a", b="b"):
    """Two words that every polynomial hash modulo 2**64 takes for one from 1,024 letters on."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_word_hashes_tell_crafted_words_apart():
    from winnowlane.llm import _bytes as B

    words = [w.encode() for n in (8, 16, 32, 1024, 2048) for w in twins(n)] + [b"x" * n for n in range(1, 40)] + [b"x" * n + b"y" for n in range(1, 40)]
    data, at = np.frombuffer(b" ".join(words), np.uint8), np.cumsum([0] + [len(w) + 1 for w in words])
    one, number = B.distinct_words(data, at[:-1], at[1:] - 1)
    assert len(one) == len(words) == len(set(number.tolist()))
    for half in (B.FIRST, B.SECOND):
        assert len(set(half.words(data, at[:-1], at[1:] - 1).tolist())) == len(words)
    nul = np.frombuffer(b"a\0 a\0\0 a a\0", np.uint8)
    assert len(B.distinct_words(nul, np.array([0, 3, 7, 9]), np.array([2, 6, 8, 11]))[0]) == 3
    with pytest.raises(ValueError):
        B.FIRST.pieces(data, at[-3:-2], at[-3:-2] + B.PIECE + 1)


def test_words_are_told_apart_by_bytes_if_hashes_agree(monkeypatch):
    from winnowlane.llm import _bytes as B

    monkeypatch.setattr(B, "word_pairs", lambda d, s, e: (np.zeros(len(s), np.uint64),) * 2)
    data = np.frombuffer(b"one two one six", np.uint8)
    one, number = B.distinct_words(data, np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15]))
    assert number.tolist() == [0, 1, 0, 2] and one.tolist() == [0, 1, 3]


@pytest.fixture(scope="module")
def crafted(spark):
    rng = random.Random(3)
    rest = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(40)) for _ in range(2)]
    rows = []
    for n in (1024, 2048):
        x, y = twins(n)
        rows += [(len(rows), f"{x} {rest[0]}"), (len(rows) + 1, f"{rest[0][:0]}{y} {rest[0]}"), (len(rows) + 2, x), (len(rows) + 3, y)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_bpe_of_crafted_words(crafted):
    import public_tokenizers
    from tokenizers import Tokenizer

    from winnowlane.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe.encode_digest(crafted[0].coalesce(1), path).collect():
        ids = lib.encode(crafted[1][r.doc_id][1], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_anchors_of_crafted_words(crafted):
    from winnowlane.llm import anchors

    c, rows = Counter(), crafted[1]
    for _, t in rows:
        w = re.findall(WORD, t)
        c.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    for r in anchors.remove_repeats(crafted[0]).collect():
        w = re.findall(WORD, rows[r.doc_id][1])
        gone = {k + j for k in range(len(w) - 34) if c[tuple(w[k : k + 35])] > 1 for j in range(35)}
        assert r.n_removed == len(gone), r.doc_id
    mixed = anchors.remove_repeats(crafted[0].withColumn("doc_id", F.col("doc_id").cast("smallint")))
    assert mixed.schema["doc_id"].dataType.simpleString() == "smallint" and mixed.count() == len(rows)


def test_join_and_fingerprints_of_crafted_words(crafted):
    from winnowlane.llm import imatch, ngram_join

    out = {r.doc_id: r.n_links for r in ngram_join.link(crafted[0]).collect()}
    assert all(out[i] == 0 for i in (2, 3, 6, 7))
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprint(crafted[0]).collect()}
    assert len({prints[i] for i in (2, 3, 6, 7)}) == 4


def _fingerprint(terms, band):
    """The definition, term by term, on Python integers."""
    from winnowlane.llm import _bytes as B
    from winnowlane.llm import imatch

    m = 2**64
    mix = lambda x: int(B.mix(np.array([x % m], np.uint64))[0])
    held = [t for t in terms if t in band] or list(terms)
    if not held:
        return ""
    out = ""
    for k, odd in enumerate(int(x) | 1 for x in B.stream(0x1A7C4, imatch.DRAWS)):
        own = [t for t in held if t * odd % m < m >> imatch.rate_bits(k)] or held
        h = mix(sum(mix(t ^ 0xA5A5A5A5) for t in own)) | 1
        out += f"{(h >> 32) | 1:08x}"
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_imatch_against_its_definition(spark, monkeypatch, broadcast):
    from winnowlane.llm import _bytes as B
    from winnowlane.llm import imatch

    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 25))) for _ in range(500)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 150))) for _ in range(60)] + ["", None, "lone", "  \n", vocab[0], "a " * 500]
    texts += [texts[0]] * 3
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(8, "repeats an id"), (8, texts[4])]
    monkeypatch.setattr(imatch, "BROADCAST_CHUNKS", broadcast)
    monkeypatch.setattr(imatch, "CHUNK_BYTES", 2000)  # several chunks

    def terms(t):
        w = sorted(set(re.findall(WORD, t or "")))
        data, ends = np.frombuffer("".join(w).encode(), np.uint8), np.cumsum([len(x.encode()) for x in w])
        return {int(h) for h in B.FIRST.words(data, np.r_[0, ends[:-1]], ends)} if w else set()

    df = Counter(t for _, x in rows for t in terms(x))
    band = {t for t, n in df.items() if imatch.LEAST_DOCS <= n <= max(imatch.LEAST_DOCS, math.floor(len(rows) * imatch.MOST_SHARE))}
    rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    alike = lambda a, b: float(a == b) if not (a and b) else float(np.mean([x == y for x, y in zip(re.findall("." * 8, a), re.findall("." * 8, b))]))
    want = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        a, b, c = (_fingerprint(terms(x), band) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, alike(a, b), alike(a, c)))
    got = [tuple(r) for r in imatch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[5] for r in got) > 3 * sum(r[6] for r in got[:60] if r[0] < 110)
    with pytest.raises(TypeError):
        imatch.fingerprint(spark.createDataFrame([("x", "t")], "doc_id string, text string"))


def test_keep_one_loses_no_text(spark):
    from winnowlane.llm import ngram_join

    rng = random.Random(2)
    a, b, c = (" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(60)) for _ in range(3))
    rows = [(7, a, 1), (7, b, 1), (3, b + " more", 2), (5, c, 3), (5, c, 3), (5, c, 4), (None, c, 5), (None, c, 5), (8, None, 6), (8, None, 6), (9, "", 7)]
    f = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = [sorted(map(tuple, ngram_join.keep_one(f.repartition(n)).collect(), ), key=repr) for n in (1, 3)]
    assert out[0] == out[1]
    kept = Counter((i, t) for i, t, _ in out[0])
    assert kept == {(7, a): 1, (3, b + " more"): 1, (5, c): 1, (None, c): 2, (8, None): 2, (9, ""): 1}
    links = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.link(f).collect()}
    assert {(7, 7, 0), (7, 3, 1), (3, 3, 1), (5, 5, 2), (8, 8, 0)} <= links


def test_components_of_a_hub(spark):
    from winnowlane.llm._components import components

    edges = [(5, k) for k in range(6, 400)] + [(k, 1000 + k) for k in range(6, 60)]
    assert {r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {5}


def test_mixing_with_many_sources(spark, monkeypatch):
    from winnowlane.llm import mixing

    rows = [(i % 150, "w " * (i % 13), None if i % 5 == 0 else f"s{i % 4}") for i in range(300)]
    f = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"place": F.lit(1), "skey": F.lit("x"), "times": F.lit(0), "salt": F.lit(2)})
    want = sorted(map(tuple, mixing.plan(f).collect()))
    mixed = sorted((r.doc_id, r.text) for r in mixing.mix(f).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.plan(f).collect())) == want
    assert sorted((r.doc_id, r.text) for r in mixing.mix(f).collect()) == mixed and mixing.mix(f).columns == f.columns


def _spans(text, words):
    return [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m.group().lower() in words]


@pytest.mark.parametrize("elsewhere,broadcast", [(None, 10), (0.5, 10**6), (0.5, 0)])
def test_disclosure_terms_with_repeated_rows(spark, elsewhere, broadcast):
    from winnowlane.llm import disclosure

    rng = random.Random(13)
    vocab = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(120)]
    texts = [" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(40)]
    texts += [f"zyx {texts[0]} mail p@q.org"] * 3 + [f"zyx in {texts[k]}" for k in range(17)] + [f"Quill says r@s.net +1 555 010 9999 {texts[1]}", "Quill alone", f"abc r@s.net {texts[3]}"]
    rows = [(i if t != texts[40] else 40, t) for i, t in enumerate(texts)] + [(90, None), (91, "")]
    email, phone = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\+[0-9][\x20().0-9-]+[0-9]"
    bases = [sorted([("email", *m.span(), m.group().lower()) for m in re.finditer(email, t or "")] + [("phone", *m.span(), re.sub(r"\D", "", m.group())) for m in re.finditer(phone, t or "")], key=lambda x: (x[0], x[1])) for _, t in rows]
    words = [{w.lower() for w in re.findall(r"[^\W_]+", t or "")} for _, t in rows]
    ents = [{(k, x) for k, _, _, x in b} for b in bases]
    n, n_term, n_ent = len(rows), Counter(w for x in words for w in x), Counter(e for x in ents for e in x)
    both = Counter((e, w) for x, y in zip(ents, words) for e in x for w in y)
    given = {(e, w): (k + n_ent[e] / n) / (n_term[w] + 1) for (e, w), k in both.items()}
    tells = {p for p, g in given.items() if math.log(g / (n_ent[p[0]] / n)) >= -0.8 * math.log(n_ent[p[0]] / n)}
    pointing = {w for e, w in tells if elsewhere is not None and given[e, w] >= elsewhere}
    f = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("x"))
    out = Counter((r.doc_id, r.spans) for r in disclosure.report(f, elsewhere=elsewhere, broadcast=broadcast).collect())
    assert out == Counter((r.doc_id, r.spans) for r in disclosure.report(f, elsewhere=elsewhere, broadcast=broadcast, broadcast_rows=0).collect())
    want = Counter()
    for (i, t), b, e, w in zip(rows, bases, ents, words):
        marks = {x for x in w if any((k, x) in tells for k in e)} | (w & pointing)
        free = [s for s in _spans(t or "", marks) if not any(x < s[1] and s[0] < y for _, x, y, _ in b)]
        want[i, ",".join([f"{k}:{x}:{y}" for k, x, y, _ in b] + [f"term:{x}:{y}" for x, y in free])] += 1
    assert out == want
    # three rows of one text count three times, not nine: zyx stands in 20 documents, 3 of them with the address
    assert (("email", "p@q.org"), "zyx") in given and abs(given[("email", "p@q.org"), "zyx"] - (3 + 3 / n) / 21) < 1e-12
    clean = [r.text for r in disclosure.sanitise(f, elsewhere=elsewhere, broadcast=broadcast).collect()]
    assert len(clean) == n and not any("@" in (t or "") for t in clean)


def test_disclosure_with_very_many_matches(spark):
    from winnowlane.llm import disclosure

    t = " ".join(f"u{i}@x.org" for i in range(700)) + " end"
    r = disclosure.report(spark.createDataFrame([(1, t)], "doc_id long, text string")).head()
    assert r.n_email == 700 and r.base_sha256 == hashlib.sha256(",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+@\S+", t)).encode()).hexdigest()
    s = disclosure.sanitise(spark.createDataFrame([(1, t), (2, "plain")], "doc_id long, text string")).where("doc_id = 1").head().text
    assert s.split()[:700] == ["<EMAIL>"] * 700
    with pytest.raises(ValueError):
        disclosure.find(spark.createDataFrame([(1, t, 1)], "doc_id long, text string, _all int"))


def _reference_score(g, text):
    """The grammar without transducers: looks at the words around each insult or threat."""
    from winnowlane.llm import toxicity as T

    best = 0.0
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        tokens = re.findall(r"[^\W\d_]+|[,:\"“”«»]", clause)
        for i, w in enumerate(tokens):
            kind, weight = None, 0.0
            if w in T.TARGETS or w in T.NEGATIONS or w in T.REPORTS:
                continue
            stems = [g.stems[w[:k]] for k in T.STEMS if len(w) > k and w[:k] in g.stems]
            if w in g.insults:
                kind, weight = "insult", g.insults[w]
            elif w in T.THREATS:
                kind, weight = "threat", g.threats.get(w, T.THREAT_WEIGHT)
            elif stems:
                kind, weight = "insult", max(stems)
            if kind is None:
                continue
            before = [x for x in tokens[:i] if x.isalpha()]
            negated = any(x in T.NEGATIONS for x in before[-T.REACH :])
            pause = next((j for j in range(i + 1, len(tokens)) if not tokens[j].isalpha()), None)
            later = next((j for j in range(len(tokens) - 1, i, -1) if tokens[j] in T.REPORTS), None)
            # from the clause's end: the last verb of reporting, then a pause before it, then the insult
            behind = later is not None and any(not x.isalpha() for x in tokens[i + 1 : later])
            reported = any(x in T.REPORTS for x in tokens[:i]) or (pause is not None and behind)
            aimed = any(x in T.TARGETS for x in tokens[:i] + tokens[i + 1 :])
            how = "negated " if negated else "reported " if reported else "aimed " if aimed else ""
            best = max(best, T.FLOOR, weight + g.kinds[how + kind])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, g.bias + best))))


def _labelled(spark, seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("klmnop") for _ in range(6)) for _ in range(200)]
    rows = []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(3, 40))]
        bad = i % 6 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["grubbel", "snarkwort", "snarkling"]))
        if i % 10 == 1:
            w[rng.randrange(len(w))] = rng.choice(["burn", "no", "said", "you"])
        rows.append((i, " ".join(w), int(bad)))
    f = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return f.select("doc_id", "text"), f.select("doc_id", "toxic")


def test_toxicity_against_a_slow_scorer(spark):
    from winnowlane.llm import toxicity

    docs, labels = _labelled(spark)
    g = toxicity.fit(docs, labels)
    rng = random.Random(8)
    parts = ["grubbel", "snarkwort", "snarklings", "burn", "kill", "not", "never", "said", "you", "they", "plain", "word", ",", ".", ":", "!", "\n", '"', "isn't", "so", "very"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, "", "a " * 3000 + "grubbel"]
    f = spark.createDataFrame([(i % 500, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted((r.doc_id, round(r.score, 12)) for r in toxicity.score(f, g).collect())
    assert got == sorted((i % 500, round(_reference_score(g, t), 12)) for i, t in enumerate(texts))
    assert toxicity.keep_clean(f, g).columns == f.columns


def test_toxicity_orders_ways_of_saying(spark):
    from winnowlane.llm import toxicity

    for g in (toxicity.fit(*_labelled(spark)), toxicity.Grammar({"grubbel": 4.0}, {})):
        s = g.score
        assert s("I will burn you") > s("I will see you") and s("burn it") > s("take it")
        assert s("such a grubbel") > s("not such a grubbel") and s("I will burn you") > s("I will never burn you")
        assert s("such a grubbel") > s("he said such a grubbel") and s("such a grubbel") > s("such a grubbel, he said")
        assert s("I will burn you") > s("he said: I will burn you")
        assert s("you grubbel") > s("such a grubbel") >= s("such a thing")
    assert not g.best("the said word is not here")


def test_rollup_survives_a_crash_and_compacts(spark, tmp_path):
    import public_tokenizers

    from winnowlane.llm import rollup

    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (3, "d", "en", "s")], "doc_id long, text string, lang string, source string")
    counts = {"words-1": rollup.word_tokens(F.col("text"))}
    path = f"file://{tmp_path}/r"
    state = rollup.TokenRollup(spark, path)
    state.commit("a", rollup.inserts(docs, counts))
    # a crash after the sums, before the marker has its name: a folder, and a draft that is half written
    rollup.inserts(docs, counts).groupBy("source", "lang", "tokenizer_version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/deltas/b-dead")
    (tmp_path / "r" / "commits" / ".draft").write_bytes(b"\0")
    want = {("s", "en", 3, 7), (None, None, 1, 0)}
    totals = lambda: {(r.source, r.lang, r.n_docs, r.n_tokens) for r in rollup.TokenRollup(spark, path).totals().collect()}
    assert totals() == want and len(state.old_folders()) == 1
    assert not state.commit("a", rollup.inserts(docs, counts))
    assert state.commit("empty", rollup.inserts(docs.limit(0), counts)) and totals() == want
    assert state.compact() == 2 and totals() == want and len(state.old_folders()) == 3
    assert not state.commit("a", rollup.inserts(docs, counts)) and totals() == want
    state.commit("c", rollup.deletes(docs.where("doc_id = 1"), counts))
    assert totals() == {("s", "en", 1, 1), (None, None, 1, 0)}
    assert state.compact() == 3 and totals() == {("s", "en", 1, 1), (None, None, 1, 0)}
    bpe = rollup.bpe_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), "bpe-49k")
    state.commit("d", rollup.counted(bpe))
    assert {(r.source, r.n_tokens) for r in state.totals().where("tokenizer_version = 'bpe-49k'").collect()} == {("s", 7), (None, 0)}
    with pytest.raises(ValueError):
        state.commit(".x", rollup.counted(bpe))


def test_groups_of_several_blocks_without_broadcast(spark, monkeypatch):
    from winnowlane.llm import _blocks, embedding_dedup, ngram_join

    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + rng.standard_normal(16) * 0.03).astype(np.float32).tolist(), 1) for i in range(90)] + [(i, rng.standard_normal(16).astype(np.float32).tolist(), 1) for i in range(90, 130)]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    f = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    words = [" ".join(f"w{k % 6}x{j if j not in (k, k // 2) else 'z'}" for j in range(90)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    want = None
    for limit, block in ((200_000, 1024), (200_000, 4), (0, 4)):
        monkeypatch.setattr(_blocks, "BROADCAST_GROUPS", limit)
        got = {r.vec_id: r.n_links for r in embedding_dedup.link(f, block=block).collect()}
        assert got == {i: int(near[i].sum()) for i in range(130)} and near.any()
        for whole in (7000, 1):
            links = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.link(docs, block=block, whole=whole).collect()}
            assert want is None or links == want
            want = links


def test_few_bits_where_tables_would_be_too_many():
    from winnowlane.llm import embedding_dedup

    bits, tables = embedding_dedup.layout(10**9, 0.98)
    assert bits == 35 and tables < 255 and (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= 1e-6
    bits, tables = embedding_dedup.layout(10**9, 0.5)
    assert tables <= 255 and (1 - (1 - math.acos(0.5) / math.pi) ** bits) ** tables <= 1e-6


def test_stages_leave_their_result_only(spark):
    from winnowlane import scratch

    n = len(scratch._MADE)
    first = scratch.only(lambda: scratch.materialize(spark.range(3), "inner").where("id > 0"), "outer")
    assert len(scratch._MADE) == n + 1 and sorted(r.id for r in first.collect()) == [1, 2]
    second = scratch.only(lambda: first.where("id > 1"), "next")
    scratch.drop(first)
    assert len(scratch._MADE) == n + 1 and [r.id for r in second.collect()] == [2]


def test_exchange_with_buckets_by_size(spark, crafted, monkeypatch, tmp_path):
    from winnowlane.llm import _exchange, anchors, suffix

    crafted[0].write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = [sorted(map(tuple, f(docs).collect())) for f in (anchors.remove_repeats, suffix.remove_repeats)]
    monkeypatch.setattr(_exchange, "BUCKET_BYTES", 7)
    assert _exchange.buckets(docs) > 100
    assert [sorted(map(tuple, f(docs).collect())) for f in (anchors.remove_repeats, suffix.remove_repeats)] == want


def test_vectors_of_mixed_lengths(spark):
    from winnowlane.llm import embedding_dedup

    rng = np.random.default_rng(12)
    rows = []
    for dim in (1, 3, 64, 5000):
        v = rng.standard_normal(dim)
        rows += [(len(rows) + k, (v * (k + 1)).tolist(), "x") for k in range(3)]  # the same direction at three scales
    rows += [(50, [1e-300, 1e-300, 0.0], "x"), (51, [1e300, 1e300, 0.0], "x"), (52, rows[3][1] + [0.0], "x"), (7, rows[7][1], "x")]
    near = {}
    for a, (i, x, _) in enumerate(rows):
        for b, (j, y, _) in enumerate(rows):
            if a != b and len(x) == len(y):
                p, q = (np.array(z) / np.abs(z).max() for z in (x, y))
                near[a] = near.get(a, 0) + int(p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.98)
    out = sorted((r.vec_id, r.n_links) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect())
    assert out == sorted((r[0], near.get(k, 0)) for k, r in enumerate(rows))
