"""The pipeline's rows against a brute-force version of its five stages, with nulls, repeats, long texts and extra columns."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.test_exact import _reference_score
from tests.llm.test_llm import PII, WORD, group, valid

MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def make(rng):
    vocab = ["".join(rng.choice("ghijkl") for _ in range(6)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = []
    for i in range(160):
        t = prose(rng.randint(6, 90))
        if i % 8 == 0:
            t += f" you {rng.choice(['grubbel', 'snarkwort'])} {prose(3)}"
        if i % 9 == 0:
            t += f" Name{i} writes from m{i}@x.example or 10.0.{i % 200}.7 and +1 555 010 {1000 + i}"
        rows.append([i, t, "en" if i % 2 else None, None if i % 11 == 0 else f"s{i % 4}"])
    for k in range(12):  # near and exact copies
        w = rows[k * 7 + 1][1].split()
        if k % 2 and len(w) > 60:
            w[5] = "changed"
        rows.append([300 + k, " ".join(w), "en", "s1"])
    rows += [[400, None, None, "s2"], [401, "", "en", None], [402, prose(9000), "en", "s3"], [403, "a" * 3000, "en", "s0"], [404, "Name9 alone", "en", "s1"], [3, rows[3][1], "en", "s3"], [5, prose(30), "en", "s1"]]
    return rows


def sanitised(rows):
    """Base spans and disclosing terms replaced, term by term."""
    texts = [t or "" for _, t, *_ in rows]
    bases = [[(k, *m.span()) for k, p in PII.items() for m in re.finditer(p, t) if valid(k, m.group())] for t in texts]
    entity = lambda k, x: (k, x.lower() if k == "email" else x if k == "ip" else re.sub(r"\D", "", x))
    ents = [{entity(k, t[a:b]) for k, a, b in s} for t, s in zip(texts, bases)]
    words = [{w.lower() for w in re.findall(r"[^\W_]+", t)} for t in texts]
    n, n_term, n_ent = len(rows), Counter(w for x in words for w in x), Counter(e for x in ents for e in x)
    both = Counter((e, w) for x, y in zip(ents, words) for e in x for w in y)
    given = {p: (k + n_ent[p[0]] / n) / (n_term[p[1]] + 1) for p, k in both.items()}
    tells = {p for p, g in given.items() if math.log(g / (n_ent[p[0]] / n)) >= -0.8 * math.log(n_ent[p[0]] / n)}
    pointing = {w for e, w in tells if given[e, w] >= 0.5}
    out = []
    for (i, t, *rest), s, e, w in zip(rows, bases, ents, words):
        marks = {x for x in w if any((k, x) in tells for k in e)} | (w & pointing)
        spans = [(a, -b, MASKS[k]) for k, a, b in s]
        for m in re.finditer(r"[^\W_]+", t or ""):
            if m.group().lower() in marks and not any(a < m.end() and m.start() < b for _, a, b in s):
                spans.append((m.start(), -m.end(), "<NUMBER>" if re.fullmatch("[0-9]+", m.group()) else "<TERM>"))
        new, at = "", 0
        for a, b, name in sorted(spans):
            if a >= at:
                new += t[at:a] + name
            at = max(at, -b)
        out.append([i, new + t[at:] if spans else t, *rest])
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from winnowlane.llm import mixing, toxicity

    rows = make(random.Random(21))
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("long")).withColumn("node", F.lit("x")).withColumn("place", F.lit(1)).repartition(3)
    labels = spark.createDataFrame([(i, int("grubbel" in (t or "") or "snarkwort" in (t or ""))) for i, t, *_ in rows if i < 160], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    grammar = toxicity.fit(docs, labels)
    left = [r for r in rows if _reference_score(grammar, r[1]) < 0.5]
    assert 0 < len(rows) - len(left) < 60
    sets = []
    for _, t, *_ in left:
        w = re.findall(WORD, t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    edges = [(a, b) for a in range(len(left)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    classes: dict = {}
    for k, c in group(range(len(left)), edges).items():
        classes.setdefault(c, []).append(k)
    one = [min(m, key=lambda k: left[k][0]) for m in classes.values()]
    # texts that share the least id of a class are equal here, so which of them stays is no matter
    clean = sanitised([left[k] for k in one])

    frame = spark.createDataFrame([(k, r[0]) for k, r in enumerate(clean)], "k long, doc_id long")
    place = {r.k: r.p for r in frame.select("k", mixing.position(F.col("doc_id")).alias("p")).collect()}
    size = [len(re.findall(WORD, r[1] or "")) for r in clean]
    by = Counter()
    for r, n in zip(clean, size):
        by[r[3]] += n
    order = sorted(s for s in by if s is not None) + [None]
    spare, open_, target = 1.5 * sum(by.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while open_:
        share = spare / sum(open_.values())
        full = [s for s, w in open_.items() if share * w > 2 * by[s]]
        if not full:
            target |= {s: share * w for s, w in open_.items()}
            break
        for s in full:
            target[s] = 2.0 * by[s]
            spare -= target[s]
            del open_[s]
    want = Counter()
    for s in order:
        whole = math.floor(target[s] / by[s]) if by[s] else 0
        budget = target[s] - whole * by[s]
        seen = Counter()
        for k, r in enumerate(clean):
            if r[3] == s:
                seen[place[k]] += size[k]
        upto, cut, at_cut = 0, None, False
        for p in sorted(seen):
            if upto + seen[p] > budget:
                cut, at_cut = p, seen[p] > 0 and 2 * (budget - upto) >= seen[p]
                break
            upto += seen[p]
        for k, r in enumerate(clean):
            if r[3] == s:
                more = budget > 0 and (cut is None or place[k] < cut or (place[k] == cut and at_cut))
                want[r[0], r[1], r[2], r[3]] += whole + int(more)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in out) == +want
    for r in out:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert r.n_chars == (None if r.text is None else len(r.text)) and r.node == "x" and r.place == 1


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
