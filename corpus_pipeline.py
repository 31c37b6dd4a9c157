"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, tokens.

Each stage takes documents and returns documents, written as Parquet and read again in between.
Toxic documents go; one document of each group of near copies stays; personal data and what
discloses it is replaced; sources are mixed to their targets, so a document may be taken twice or not
at all; and what is left is encoded. The last stage returns its input's columns, token_ids,
n_tokens and decoded.

Every stage takes whole texts of any length, and other columns as they are; the names token_ids, n_tokens, decoded,
_base, _all, _row, _salt, _terms and those of the kinds of personal data with an underscore must be free, or an error is
raised. A null or empty text is not toxic, has no copies and nothing to replace, counts no words, so that the mix takes it once for
every whole time that its source is taken, and has no tokens. Rows that repeat an id are documents of their own: of alike ones
one stays, unlike ones all do, and the mix takes them together. Ties go by the smallest id, then by a hash of the
text. Empty tables give an empty result with all columns.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from winnowlane.llm import bpe, disclosure, mixing, ngram_join, toxicity
from winnowlane.llm._scratch import drop, only


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on labels of these documents, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8."""
    return ngram_join.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, replaced."""
    return disclosure.sanitise(docs, elsewhere=disclosure.ELSEWHERE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("personal data", sanitise), ("mixing", mix_sources), ("tokens", tokenise)]

#: SQL can express neither the fitted grammar nor BPE; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's intermediate tables go once its result is written, and its input, if a stage made it, with them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        before, docs = docs, only(partial(stage, spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if number:
            drop(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
