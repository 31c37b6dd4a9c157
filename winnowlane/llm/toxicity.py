"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps the words of a clause to symbols with weights: insults, threats, targets,
negations, verbs of reported speech, pauses. It is composed with transducers that rewrite the symbols
of insults and threats: in reach of a negation, after a verb of reporting, beside a target. What
stands to the right of a symbol is read by a second composition from the clause's end. So a clause is
scored by how its parts stand to each other, by the weights of its word and of the way it is said.

A few common insults and threats start the lexicon. What they weigh is learned from labelled documents, as are
all further words and stems that mark those, and what each way of saying them adds or takes away.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowlane.llm._scratch import materialize
from winnowlane.llm.bpe import text_batches

# The grammar's own words, in several languages.
INSULTS = ("asshole", "bastard", "bitch", "cretin", "dickhead", "dumbass", "idiot", "imbecile", "jackass", "jerk", "moron", "scumbag", "stupid", "arschloch", "dummkopf", "trottel", "vollidiot", "connard", "crétin", "imbécile", "salaud", "cabrón", "estúpido", "imbécil", "pendejo")
THREATS = ("kill", "hurt", "harm", "murder", "shoot", "stab", "strangle", "beat", "burn", "destroy", "töten", "umbringen", "verprügeln", "tuer", "frapper", "brûler", "matar", "golpear", "quemar")
TARGETS = ("you", "your", "yours", "yourself", "they", "them", "he", "she", "him", "her", "du", "dich", "dir", "ihr", "euch", "tu", "toi", "te", "vous", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "no", "never", "without", "cannot", "isn", "aren", "wasn", "don", "doesn", "didn", "won", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "ni", "sin")
REPORTS = ("said", "says", "say", "called", "calls", "quoted", "wrote", "writes", "claimed", "claims", "reported", "told", "sagte", "nannte", "schrieb", "dit", "écrit", "dijo", "escribió")

#: At most so many labelled rows are fitted on, chosen by a hash of the id. They bound the learned entries.
FIT_ROWS = 20_000
#: Lengths of learned stems; a stem also stands for the words that begin with it.
STEMS = range(4, 8)
#: The least support and log-odds of a learned entry.
SUPPORT, LEAST = 3, 3.0
LETTERS = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[,:\"\u201c\u201d\u00ab\u00bb]")
#: Words whose symbols a worker remembers.
MEMO = 80_000
#: How many words a negation reaches, and the least that a matched clause adds.
REACH, FLOOR = 3, 0.05
#: Log-odds of the grammar's own insults and threats of which the labels say nothing, and the rows that these count for.
INSULT_WEIGHT, THREAT_WEIGHT, OWN_ROWS = 5.0, 2.0, 4

# Symbols. An insult or threat takes marks on its way through the transducers.
O, INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE = 0, 1, 2, 4, 8, 16, 32
NEGATED, REPORTED, AIMED = 64, 128, 256
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat", "negated threat", "reported threat")
#: What each way of saying adds before labels are seen, and the bounds of what they can make of it, against the plain form.
SAID = {"": (0.0, -2.0, 2.0), "aimed ": (0.5, 0.1, 3.0), "negated ": (-3.0, -9.0, -0.2), "reported ": (-2.5, -9.0, -0.2)}
#: Documents that the first guess of SAID counts for.
SAID_ROWS = 4


class Table:
    """A transducer given by its arcs: (state, symbol) to (state, symbol put out). A symbol without an arc passes
    unchanged and leads to ``other`` of the state. Arcs of weight 0."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int]], other: dict[int, int]):
        self.start, self.arcs, self.other = 0, arcs, other

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        got = self.arcs.get((state, symbol))
        return (*got, 0.0) if got else (self.other[state], symbol, 0.0)


class Composed:
    """The composition of two transducers: the second reads what the first puts out; weights add. States are made as they are met."""

    def __init__(self, a, b, keep: bool = True):
        self.a, self.b, self.start = a, b, (a.start, b.start)
        self.table: dict | None = {} if keep else None

    def step(self, state: tuple, symbol) -> tuple[tuple, int, float]:
        if self.table is not None and (got := self.table.get((state, symbol))) is not None:
            return got
        s, middle, w = self.a.step(state[0], symbol)
        t, out, v = self.b.step(state[1], middle)
        got = (s, t), out, w + v
        if self.table is not None:
            self.table[state, symbol] = got
        return got


def transduce(machine, symbols: Iterable) -> list[tuple[int, float]]:
    """What a machine puts out for a sequence, with weights."""
    state, out = machine.start, []
    for x in symbols:
        state, y, w = machine.step(state, x)
        out.append((y, w))
    return out


def _marked(mark: int) -> list[tuple[int, int]]:
    """Every form of an insult or threat, and the same with a mark."""
    marks = [0, NEGATED, REPORTED, NEGATED | REPORTED]
    forms = [k | m | a for k in (INSULT, THREAT) for m in marks for a in (0, AIMED)]
    return [(f, f | mark) for f in forms]


def _negation(words: int) -> Table:
    """Marks insults and threats up to so many words after a negation; state: words still reached."""
    arcs = {(s, NEGATION): (words, NEGATION) for s in range(words + 1)}
    arcs |= {(s, x): (s - 1, y) for s in range(1, words + 1) for x, y in _marked(NEGATED)}
    arcs |= {(s, PAUSE): (s, PAUSE) for s in range(words + 1)}
    return Table(arcs, {s: max(0, s - 1) for s in range(words + 1)})


def _after(symbol: int, mark: int) -> Table:
    """Marks insults and threats anywhere after a symbol."""
    return Table({(0, symbol): (1, symbol)} | {(1, x): (1, y) for x, y in _marked(mark)}, {0: 0, 1: 1})


def _after_pause(symbol: int, mark: int) -> Table:
    """Marks insults and threats after a symbol and then a pause, as read."""
    arcs = {(0, symbol): (1, symbol), (1, PAUSE): (2, PAUSE)} | {(2, x): (2, y) for x, y in _marked(mark)}
    return Table(arcs, {0: 0, 1: 1, 2: 2})


class Lexicon:
    """The transducer of one state that reads words: it puts out their symbols, with weights."""

    start = 0

    def __init__(self, insults: dict[str, float], stems: dict[str, float], threats: dict[str, float]):
        self.symbols = {w: (s, 0.0) for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
        self.symbols |= {c: (PAUSE, 0.0) for c in ",:\"\u201c\u201d\u00ab\u00bb"}
        self.symbols |= {w: (THREAT, threats.get(w, THREAT_WEIGHT)) for w in THREATS}
        self.symbols |= {w: (INSULT, x) for w, x in insults.items()}
        self.stems, self.memo = stems, {}

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol and weight; a worker remembers those of MEMO words."""
        if (got := self.memo.get(word)) is None:
            if (got := self.symbols.get(word)) is None:
                best = max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)
                got = (INSULT, best) if best else (O, 0.0)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got

    def step(self, state: int, word: str) -> tuple[int, int, float]:
        return state, *self.symbol(word)


@dataclass
class Grammar:
    """A fitted grammar: lexicon weights, what each way of saying adds, and the log-odds without any matched clause."""

    insults: dict[str, float]
    stems: dict[str, float]
    threats: dict[str, float] = field(default_factory=dict)
    kinds: dict[str, float] = field(default_factory=lambda: {k: SAID[k.removesuffix(k.split()[-1])][0] for k in KINDS})
    bias: float = -3.0

    def __post_init__(self):
        self.lexicon = Lexicon(self.insults, self.stems, self.threats)
        context = Composed(Composed(_negation(REACH), _after(REPORT, REPORTED)), _after(TARGET, AIMED))
        self.forward = Composed(self.lexicon, context, keep=False)
        self.backward = Composed(_after_pause(REPORT, REPORTED), _after(TARGET, AIMED))

    def plain(self) -> tuple:
        """What a worker needs to make the same grammar."""
        return self.insults, self.stems, self.threats, self.kinds, self.bias

    def clause(self, words: list[str]) -> Iterator[tuple[str, float]]:
        """Kind and lexicon weight of each insult or threat of one clause, in order."""
        read = transduce(self.forward, words)
        marks = transduce(self.backward, (y for y, _ in reversed(read)))
        for (_, weight), (symbol, _) in zip(read, reversed(marks)):
            if symbol & (INSULT | THREAT) and not symbol & (TARGET | NEGATION | REPORT | PAUSE):
                how = "negated " if symbol & NEGATED else "reported " if symbol & REPORTED else "aimed " if symbol & AIMED else ""
                yield how + ("insult" if symbol & INSULT else "threat"), weight

    def clauses(self, text: str) -> Iterator[tuple[str, float]]:
        """Kind and lexicon weight of each insult or threat, clause by clause."""
        words: list[str] = []
        for token in [*TOKEN.findall(text.lower()), "."]:
            if token in ".!?;\n":
                yield from self.clause(words)
                words = []
            else:
                words.append(token)

    def best(self, text: str | None) -> tuple[str, float, float] | None:
        """Kind, lexicon weight and gain of the clause that tells most; None without any."""
        symbol = self.lexicon.symbol
        if not text or not any(symbol(w)[0] & (INSULT | THREAT) for w in set(LETTERS.findall(text.lower()))):
            return None
        found = ((k, w, max(FLOOR, w + self.kinds[k])) for k, w in self.clauses(text))
        return max(found, key=lambda x: (x[2], x[0]), default=None)

    def score(self, text: str | None) -> float:
        """Probability of the label: from the clause that tells most, and the bias."""
        found = self.best(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + (found[2] if found else 0.0)))))


def features(text: str | None) -> set[str]:
    """Words and stems of a text; a stem is marked by a star and stands for longer words only."""
    words = {w for w in TOKEN.findall((text or "").lower()) if len(w) > 2}
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Grammar:
    """A grammar from labelled rows whose crc32 of the id modulo 5 is not 0.

    Fits on at most ``rows`` labelled rows, those of the smallest hash of the id. Rows without a
    label or id are left out; of an id labelled more than once the largest label holds; documents that
    repeat a labelled id count each. Without labelled rows of both kinds the grammar's own words and
    ways of saying keep their first weights. Only words of a text are used, of whole texts.
    """
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(rows)
    # ``rows`` bounds the broadcast and what the sample holds
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = materialize(sample, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[toxic > 0].update(features(text))
                seen[toxic > 0][""] += 1
        names = list({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), "neg": pa.array([seen[0][n] for n in names], pa.int64()), "pos": pa.array([seen[1][n] for n in names], pa.int64())})

    counted = sample.mapInArrow(count, "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counted = materialize(counted, "features")
    totals = counted.where("f = ''").collect()
    if not totals or not totals[0].neg or not totals[0].pos:
        return Grammar(dict.fromkeys(INSULTS, INSULT_WEIGHT), {})
    neg, pos = totals[0].neg, totals[0].pos
    weight = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    rate, n = F.col("pos") / (F.col("pos") + F.col("neg")), F.col("pos") + F.col("neg")
    base = pos / (pos + neg)
    # how unlikely so many toxic documents are by chance, against the number of entries tried
    surprise = n * (rate * F.log(rate / base) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    tried = counted.where(f"pos + neg >= {SUPPORT}").count()
    own = F.col("f").isin(*INSULTS, *THREATS, *TARGETS, *NEGATIONS, *REPORTS)
    weighed = counted.where(F.col("f") != "").withColumn("w", weight)
    found = weighed.where(~own).where(F.col("pos") >= SUPPORT).where(F.col("w") >= LEAST).where(surprise > math.log(max(tried, 2)))
    kept = found.orderBy(F.desc("w"), "f").collect()  # bounded by the sample
    insults = {r.f: r.w for r in kept if not r.f.endswith("*")}
    stems = {r.f[:-1]: r.w for r in kept if r.f.endswith("*")}
    seen = {r.f: (r.pos + r.neg, r.w) for r in weighed.where(F.col("f").isin(*INSULTS, *THREATS)).collect()}
    settled = lambda w, first: max(FLOOR, (seen[w][0] * seen[w][1] + OWN_ROWS * first) / (seen[w][0] + OWN_ROWS)) if w in seen else first
    threats = {w: settled(w, THREAT_WEIGHT) for w in THREATS}
    insults |= {w: settled(w, INSULT_WEIGHT) for w in INSULTS}
    # a learned word with a learned stem weighs as the better supported of both
    insults = {w: max(x, *(stems.get(w[:k], 0.0) for k in STEMS if len(w) > k), 0.0) for w, x in insults.items()}
    grammar = Grammar(insults, stems, threats, bias=math.log((pos + 0.5) / (neg + 0.5)))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, weights = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                kind, w, _ = grammar.best(text) or ("", 0.0, 0.0)
                seen[kind, int(toxic > 0)] += 1
                weights[kind, int(toxic > 0)] += w
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in keys], pa.string()), "toxic": pa.array([t for _, t in keys], pa.int32()), "n": pa.array([seen[k] for k in keys], pa.int64()), "w": pa.array([weights[k] for k in keys], pa.float64())})

    told = {(r.kind, r.toxic): (r.n, r.w) for r in sample.mapInArrow(kinds, "kind string, toxic int, n long, w double").groupBy("kind", "toxic").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()}
    at = lambda k, t: told.get((k, t), (0, 0.0))
    grammar.bias = math.log((at("", 1)[0] + 0.5) / (at("", 0)[0] + 5.0))
    for word in ("insult", "threat"):
        for how, (first, low, high) in SAID.items():
            (a, x), (b, y) = at(how + word, 1), at(how + word, 0)
            n, ground = a + b, grammar.kinds[word] if how else 0.0
            # documents whose most telling clause is of this kind: their log-odds against those of none, less the words' own
            seen = math.log((a + 0.5) / (b + 0.5)) - grammar.bias - (x + y) / n - ground if n else 0.0
            grammar.kinds[how + word] = ground + min(high, max(low, (n * seen + SAID_ROWS * first) / (n + SAID_ROWS)))
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and score of every whole text.

    A null or empty text has the score of text without a matched clause. However long a text is, the clause that
    tells most decides; of clauses that tell the same any does. Rows that repeat an id are scored each; other columns, whatever their
    names, are not looked at; an empty table gives no rows.
    """
    plain = grammar.plain()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(*plain)
        for batch in text_batches(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([g.score(t) for t in batch.column("text").to_pylist()], pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, grammar: Grammar, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below ``limit``: nulls, repeats and extra columns as in score()."""
    plain = grammar.plain()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(*plain)
        for batch in text_batches(batches, "text"):
            yield batch.filter(pa.array([g.score(t) < limit for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
