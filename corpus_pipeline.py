"""The corpus pipeline: rules, near-duplicates, personal data, mixing, tokens.

A stage's result is written before the next stage begins, so each stage first removes what earlier ones staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noteloom.llm import minhash, mixing, pii, quality_rules, queries, sentencepieces
from noteloom.llm.common import release, staged, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive fences."""
    release(spark)
    return quality_rules.filter_documents(docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, by shingles weighted with their counts."""
    release(spark)
    return minhash.deduplicate(docs, weighting="count")


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; all rows stay."""
    release(spark)
    return pii.pseudonymise(docs, queries.SURROGATE_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to equal weights of sources, in shuffled order."""
    release(spark)
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and the round trip's digest."""
    release(spark)
    return sentencepieces.encode_decode(docs, queries.piece_model(), with_outputs=False)


STAGES = [
    ("quality_rules", keep_good),
    ("minhash_dedup", keep_first),
    ("pii_surrogates", replace_private),
    ("source_mixing", mix_sources),
    ("sentencepiece", to_tokens),
]

#: Signatures, components and tokens are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next.

    Null texts, languages and sources, empty and very long texts, ties and repeated rows are taken as each stage's operator
    states: the rules drop texts without words, one row of each class of duplicates stays, and the order of ids settles
    ties. An empty table gives an empty result; further columns, of any name, travel along up to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
