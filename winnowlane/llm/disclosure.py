"""Personal data by patterns, and information-theoretic sanitisation of what reveals it.

Patterns find e-mail addresses, IP addresses, payment cards and telephone numbers. Each is a
protected entity, those of a single document too. The corpus shows how strongly a term reveals one:
its pointwise mutual information with the entity, from a smoothed estimate, against the entity's own
information content. A term whose share of it reaches the disclosure threshold is removed, or generalised
to a wider class, wherever it stands with the entity. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowlane.llm._scratch import materialize

# The kinds in order, and their patterns. The forms that are searched for are the
# same languages written so that no start inside a run is tried again and no group recurses.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SEARCHED = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain before it is searched.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: An entity is protected if at least so many documents have it: all are.
SUPPORT = 1
#: The estimate of how often a term's documents have the entity counts so many more, which have it as often as the corpus.
PRIOR_DOCS = 1.0
#: The share of an entity's information from which a term discloses it.
DISCLOSURE = 0.8
#: In documents without the entity a term goes that more likely than not points to it.
ELSEWHERE = 0.5
MASK = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "number": "<NUMBER>"}


def _luhn(digits: Column) -> Column:
    """Payment card checksum over a string of digits."""
    n = F.length(digits)
    values = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return found.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


_SPAN = "array<struct<start:bigint,stop:bigint,found:string>>"
#: Spans that a fold gathers before it hands them on: appending to an array copies it.
RUN = 128
#: Shares of the rows of one (entity, term) or term, joined apart.
SALT = 16
#: Terms marked in documents without the entity are broadcast up to so many; beyond it they are joined salted.
BROADCAST_TERMS = 200_000
#: Hashes of documents with terms to mark, broadcast up to so many (16 MB); beyond it all documents are dealt to meet their terms.
BROADCAST_ROWS = 1_000_000


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(items: Column, state: Column, kind: str, step) -> Column:
    """What a fold over an array puts out, RUN items at a time. step(state, item): the next state and one thing put out."""

    def inner(acc: Column, x: Column) -> Column:
        return _let(step(acc["state"], x), lambda got: F.struct(got["state"].alias("state"), F.concat(acc["out"], F.array(got["out"])).cast(f"array<{kind}>").alias("out")))

    def outer(acc: Column, run: Column) -> Column:
        one = F.aggregate(run, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), inner)
        return _let(one, lambda got: F.struct(got["state"].alias("state"), F.concat(acc["out"], F.array(got["out"])).cast(f"array<array<{kind}>>").alias("out")))

    def whole(all_: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda i: F.slice(all_, i * RUN + 1, F.lit(RUN)))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(all_) > 0, F.flatten(F.aggregate(runs, start, outer, lambda acc: acc["out"]))).otherwise(F.array().cast(f"array<{kind}>"))

    return _let(items, whole)


def _positions(text: Column, pattern: Column | str) -> Column:
    """All leftmost matches with their code points: gaps and matches alternate, so their lengths add up."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.split(text, pattern, -1)
    pairs = _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))))

    def step(at: Column, x: Column) -> Column:
        begin = (at + x["gap"]).cast("bigint")
        stop = (begin + F.length(x["hit"])).cast("bigint")
        return F.struct(stop.alias("state"), F.struct(begin.alias("start"), stop.alias("stop"), x["hit"].alias("found")).alias("out"))

    return _folded(pairs, F.lit(0).cast("bigint"), "struct<start:bigint,stop:bigint,found:string>", step)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind: start, stop (code points, end exclusive) and the text found. Null text: none."""
    spans = F.filter(_positions(text, _SEARCHED[kind]), lambda s: _valid(kind, s["found"]))
    return F.when(text.rlike(_NEEDS[kind]), spans).otherwise(F.array().cast(_SPAN))


def _entity(kind: str, found: Column) -> Column:
    plain = F.lower(found) if kind == "email" else found if kind == "ip" else F.regexp_replace(found, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), plain)


def _entities(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: _entity(kind, s["found"]))


def _kinded(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).cast("array<struct<kind:string,start:bigint,stop:bigint>>")


def detect(docs: DataFrame) -> DataFrame:
    """docs with a column for each kind of pattern: its spans."""
    return docs.withColumns({f"_{k}": base_spans(F.coalesce(F.col("text"), F.lit("")), k) for k in PATTERNS})


def _terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


_ENTITY, _TERM = ["n_entity", "e1", "e2"], ["n_term", "t1", "t2"]


def _set_of(rows: str, names: tuple[str, str]) -> list[Column]:
    """128 bits that tell the set of distinct rows of a group."""
    return [F.bit_xor(F.xxhash64(rows, F.lit(k))).alias(n) for k, n in zip((1, 2), names)]


class Disclosing:
    """Which terms reveal which entities, by classes: entities, and terms, that stand in the same documents are one.

    ``held``: row, text and entities of documents that have any. With N documents, n(e) of them with the
    entity, n(t) with the term and n(e,t) with both, p(e) is n(e) / N and p(e|t) is smoothed:
    (n(e,t) + a p(e)) / (n(t) + a) for a = PRIOR_DOCS. A term reveals log(p(e|t) / p(e)) of the
    -log p(e) of an entity. Entities in fewer than ``support`` documents are not protected. Each row counts
    once, also where rows repeat.

    As n(e,t) is at most n(e), a term in too many documents reveals nothing: such terms go before they meet an entity.
    What is left meets by classes, so a document of very many entities and very many terms that
    stand nowhere else is one pair.
    """

    def __init__(self, held: DataFrame, docs: DataFrame, total: int, support: int = SUPPORT, threshold: float = DISCLOSURE):
        every = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
        seen = held.select("row", F.explode(F.array_distinct("entities")).alias("entity")).groupBy("row", "entity").agg(F.count("*").alias("m"))
        named = seen.groupBy("entity").agg(F.sum("m").alias("n_entity"), *_set_of("row", ("e1", "e2"))).where(F.col("n_entity") >= support)
        rate = F.col("n_entity") / F.lit(float(total))
        self.entities = materialize(seen.join(named, "entity").groupBy("row", *_ENTITY).agg(F.max("m").alias("m")), "entity-classes")
        # the most documents that a term may stand in and yet reveal an entity of so many; rounding is left room
        most = (F.col("n_entity") + PRIOR_DOCS * rate) / F.pow(rate, F.lit(1 - threshold)) - PRIOR_DOCS
        limits = self.entities.groupBy("row").agg(F.max(most * (1 + 1e-9)).alias("most"))
        held_terms = held.select("row", F.explode(_terms(F.col("text"))).alias("term")).groupBy("row", "term").agg(F.count("*").alias("m"))
        rare = held_terms.join(limits, "row").join(every, "term").where(F.col("n_term") <= F.col("most")).select("row", "term", "m", "n_term")
        rare = materialize(rare, "rare-terms")
        known = rare.groupBy("term").agg(F.first("n_term").alias("n_term"), *_set_of("row", ("t1", "t2")))
        self.rare = materialize(rare.drop("n_term").join(known, "term"), "term-classes")
        self.terms = self.rare.select("row", *_TERM).distinct()
        both = self.met().groupBy(*_ENTITY, *_TERM).agg(F.sum("m").alias("n_both"))
        given = (F.col("n_both") + PRIOR_DOCS * rate) / (F.col("n_term") + PRIOR_DOCS)
        content = -F.log(rate)
        told = both.where((content > 0) & (F.log(given / rate) >= threshold * content))
        self.told = materialize(told.select(*_ENTITY, *_TERM, given.alias("given")), "disclosing")

    def met(self) -> DataFrame:
        return self.entities.join(self.terms, "row")

    def marks(self) -> DataFrame:
        """row and term: terms that reveal an entity of their own document."""
        # the classes of a document: bounded by its own words and entities, however many documents an entity has
        own = _salted(self.met(), "row", self.told.drop("given"), [*_ENTITY, *_TERM]).select("row", *_TERM).distinct()
        return self.rare.join(own, ["row", *_TERM]).select("row", "term")

    def pointing(self, least: float) -> DataFrame:
        """Terms whose documents have one of their entities with at least that probability."""
        return self.rare.join(self.told.where(F.col("given") >= least).select(*_TERM).distinct(), _TERM).select("term").distinct()


def _salted(rows: DataFrame, by: str, few: DataFrame, on: list[str]) -> DataFrame:
    """An inner join with unique keys, the rows of one key shared among SALT tasks."""
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.col(by), F.lit(SALT)).cast("int")).join(few, [*on, "_salt"]).drop("_salt")


def _pointing(docs: DataFrame, telling: DataFrame, broadcast: int = BROADCAST_TERMS) -> DataFrame:
    """row and term of each document that holds one of the terms."""
    telling = materialize(telling, "telling")
    held = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.explode(_terms(F.col("text"))).alias("term"))
    return held.join(F.broadcast(telling), "term") if telling.count() <= broadcast else _salted(held, "row", telling, ["term"])


def _apart(marked: Column, base: Column) -> Column:
    """Sorted spans of terms that overlap no base span: one fold from the left, against what began before, and one from the right."""
    every = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("is_term"), b["stop"].alias("stop"))), F.transform(marked, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("is_term"), t["stop"].alias("stop")))))
    kind = "struct<start:bigint,stop:bigint,is_term:int,ok:boolean>"

    def out(x: Column, ok: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["is_term"].alias("is_term"), ok.alias("ok")).cast(kind).alias("out")

    def right(reach: Column, x: Column) -> Column:
        return F.struct(F.when(x["is_term"] == 0, F.greatest(reach, x["stop"])).otherwise(reach).cast("bigint").alias("state"), out(x, x["start"] >= reach))

    def left(begin: Column, x: Column) -> Column:
        return F.struct(F.when(x["is_term"] == 0, x["start"]).otherwise(begin).cast("bigint").alias("state"), out(x, x["ok"] & (x["stop"] <= begin)))

    once = F.reverse(_folded(every, F.lit(0).cast("bigint"), kind, right))
    twice = F.reverse(_folded(once, F.lit(2**62).cast("bigint"), kind, left))
    return _kinded(F.filter(twice, lambda x: (x["is_term"] == 1) & x["ok"]), "term")


def find(docs: DataFrame, support: int = SUPPORT, threshold: float = DISCLOSURE, elsewhere: float | None = None, broadcast: int = BROADCAST_TERMS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All columns of docs, and ``_base`` and ``_all``: arrays of (kind, start, stop), in order of kind and start.

    Disclosing terms are marked in the documents that hold the entity; with ``elsewhere`` those whose
    documents have the entity with that probability or more are marked in every document that holds them. A null
    text is empty and has no spans. Terms that overlap a base span are not marked again. Rows that repeat an
    id are documents of their own; clashing names (_base, _all) are refused; an empty table gives no
    rows.
    """
    clash = {"_base", "_all", "_row", "_salt", "_terms", *(f"_{k}" for k in PATTERNS)} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    row = F.xxhash64("doc_id", "text")
    found = detect(docs.select("doc_id", "text"))
    any_ = " + ".join(f"size(_{k})" for k in PATTERNS) + " > 0"
    entities = F.concat(*map(_entities, PATTERNS))
    held = materialize(found.where(any_).select(row.alias("row"), "text", entities.alias("entities")), "entities")
    found_terms = Disclosing(held, docs, docs.count(), support, threshold)
    mine = found_terms.marks()
    if elsewhere is not None:
        mine = mine.unionByName(_pointing(docs, found_terms.pointing(elsewhere), broadcast).select("row", "term"))
    mine = mine.groupBy("row").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    mine = materialize(mine, "terms").withColumnRenamed("row", "_row")
    base = F.concat(*[_kinded(F.col(f"_{k}"), k) for k in PATTERNS])
    rows = docs.withColumn("_row", row)
    if mine.count() <= broadcast_rows:
        # only documents with a term to mark are dealt; which they are is told by their row's hash
        ids = F.broadcast(mine.select("_row"))
        halves = [(rows.join(ids, "_row", "left_anti"), False), (rows.join(ids, "_row", "left_semi").join(mine, "_row"), True)]
    else:
        halves = [(rows.join(mine, "_row", "left"), True)]
    # whole words only; the pattern of a text lists its own terms
    words = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.col("_terms"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    marked = _kinded(_positions(F.col("text"), words), "term")
    free = _apart(marked, F.col("_base"))
    out = []
    for frame, with_terms in halves:
        found = detect(frame).withColumn("_base", base)
        every = F.when(F.col("_terms").isNull(), F.col("_base")).otherwise(F.concat("_base", free)) if with_terms else F.col("_base")
        out.append(found.withColumn("_all", every).select(*docs.columns, "_base", "_all"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each document."""
    found = find(docs.select("doc_id", "text"), **params)
    counts = [_count(k).alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"))


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """The columns of docs, with the spans of each text replaced.

    Base spans become the name of their kind. A disclosing term is generalised: one of digits to a
    number, any other to a term. A null text stays null; the column n_chars, if there, is
    counted anew where text changed.
    """
    found = find(docs, **params)
    # base spans of different kinds may overlap: one that begins within another is covered by it
    ordered = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("stop"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> Column:
        stop = -s["stop"]
        own = F.substr(F.col("text"), (s["start"] + 1).cast("int"), (stop - s["start"]).cast("int"))
        name = F.when(s["kind"] == "term", F.when(own.rlike("^[0-9]+$"), F.lit(MASK["number"])).otherwise(F.lit(MASK["term"])))
        for k in PATTERNS:
            name = name.when(s["kind"] == k, F.lit(MASK[k]))
        gap = F.substr(F.col("text"), (at + 1).cast("int"), F.greatest(F.lit(0), s["start"] - at).cast("int"))
        piece = F.concat(gap, F.when(s["start"] >= at, name).otherwise(F.lit("")))
        return F.struct(F.greatest(at, stop).cast("bigint").alias("state"), piece.alias("out"))

    last = F.aggregate("_all", F.lit(0).cast("bigint"), lambda acc, s: F.greatest(acc, s["stop"]))
    tail = F.substr(F.col("text"), (last + 1).cast("int"), F.length("text"))
    text = F.concat(F.array_join(_folded(ordered, F.lit(0).cast("bigint"), "string", step), ""), tail)
    clean = F.when(F.size("_all") > 0, text).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_all") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
