"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole document with the 49k word vocabulary."""
    import public_tokenizers

    from winnowlane.llm import bpe

    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    from winnowlane.llm import embedding_dedup

    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and its edited text."""
    from winnowlane.llm import imatch

    return imatch.fingerprint(table(spark, sf_dir, "documents"))


def op3_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stay of every whole document once repeats of 35 words are gone."""
    from winnowlane.llm import anchors

    return anchors.remove_repeats(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    from winnowlane.llm import mixing

    return mixing.plan(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    from winnowlane.llm import ngram_join

    return ngram_join.link(table(spark, sf_dir, "documents"))


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it in every whole document; what mostly stands with an entity, in every other document too."""
    from winnowlane.llm import disclosure

    return disclosure.report(table(spark, sf_dir, "documents"), elsewhere=disclosure.ELSEWHERE)


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that stay of every whole document once repeats of 50 bytes are gone from all but the first."""
    from winnowlane.llm import suffix

    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came, words were counted anew, what there was became one, and documents without words went."""
    from pyspark.sql import functions as F

    from winnowlane.llm import rollup
    from winnowlane.llm._scratch import fresh_path

    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    old, new, size = rollup.word_tokens(text), rollup.letter_tokens(text), rollup.byte_tokens(text)
    state = rollup.TokenRollup(spark, fresh_path(spark, "token-rollup"))
    state.commit("1-arrivals", rollup.inserts(docs, {"words-1": old, "bytes-1": size}))
    for _ in range(2):  # the second is a retry and changes nothing
        state.commit("2-recount", rollup.revisions(docs, {"words-1": old}, {"words-2": new}))
    state.compact()
    empty = docs.where(old == 0)
    state.commit("3-empty", rollup.deletes(empty, {"words-2": new, "bytes-1": size}))
    return state.totals()


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole document by a grammar fitted on the labelled rows that are not held out."""
    from pyspark.sql import functions as F

    from winnowlane.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws 5 % of the documents of 20 words and more towards the benchmark's n-grams; every document's weight, score and rank."""
    from winnowlane.llm import importance

    return importance.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark's windows in every whole document."""
    from winnowlane.llm import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector against all vectors; every 7th vector is labelled anew."""
    from pyspark.sql import functions as F

    from winnowlane.llm import hard_negatives

    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_embedding_dedup, op2_imatch, op3_anchors, op4_mixing, op5_ngram_join, op6_disclosure, op7_suffix, op8_token_counts, op9_bpe, op10_toxicity, op11_importance, op12_decontaminate, op13_hard_negatives)
    return {f.__name__: f for f in found}


OP8 = r"""
WITH counted AS (
  SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
         coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')), 0) AS fine, coalesce(strlen(text), 0) AS bytes
  FROM documents)
SELECT source, lang, 'words-2' AS tokenizer_version, count(*) AS n_docs, CAST(sum(fine) AS BIGINT) AS n_tokens
FROM counted WHERE words > 0 GROUP BY ALL
UNION ALL
SELECT source, lang, 'bytes-1', count(*), CAST(sum(bytes) AS BIGINT) FROM counted WHERE words > 0 GROUP BY ALL
"""


OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, dw.n, dw.win FROM dw JOIN (SELECT DISTINCT win FROM bw) USING (win)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit JOIN bw USING (win)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""


OP13 = """
WITH q AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positive AS (SELECT a, anchor_id, id, score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_token_counts": OP8, "op12_decontaminate": OP12, "op13_hard_negatives": OP13}
