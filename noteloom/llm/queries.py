"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import html_extract, merkle, minhash, mixing, pii, prefix_trie, quality_gam, quality_rules, rollup, search, sentencepieces, shards, warc
from noteloom.llm.common import broadcast_if_small, new_dir, staged, table

#: Key of the surrogates; a deployment passes its own from a secret store.
SURROGATE_KEY = "noteloom-demo-key"

SHARD_KEY = 20_240_601

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by the weighted similarity: a shingle weighs as often as it occurs."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), weighting="count")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(table(spark, sf_dir, "documents"), piece_model(), with_outputs=False)


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(*quality_rules.CONTRACT)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, each committed twice (the second time without effect).

    All documents are inserted; those labelled toxic are deleted; the others labelled bad are counted anew, with their
    white space made single spaces.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.where("doc_id IS NOT NULL AND (toxic = 1 OR quality = 0)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = staged(marks.select("doc_id", (F.col("toxic") == 1).alias("toxic")), "marks")
    # few ids are broadcast, so no text is shuffled for them
    toxic, bad = (broadcast_if_small(marks.where(kind).select("doc_id")) for kind in ("toxic", "NOT coalesce(toxic, false)"))
    counted = staged(rollup.count_tokens(docs, piece_model(), "piece_bpe_32k"), "counted")
    tidied = docs.join(bad, "doc_id", "left_semi").withColumn("text", F.regexp_replace("text", r"\s+", " "))
    revised = rollup.revisions(counted.join(bad, "doc_id", "left_semi"), rollup.count_tokens(tidied, piece_model(), "piece_bpe_32k"))
    store = rollup.TokenRollup(spark, new_dir(spark, "rollup"))
    for batch, changes in (("documents-1", rollup.inserts(counted)), ("withdrawn-1", rollup.deletes(counted.join(toxic, "doc_id", "left_semi"))), ("revised-1", revised)):
        store.commit(batch, changes)
        store.commit(batch, changes)
    return store.totals()


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), SURROGATE_KEY, entities="n_entities")
    return out.select("doc_id", "text", "n_entities")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.write_shards(table(spark, sf_dir, "documents"), piece_model(), new_dir(spark, "shards"), key=SHARD_KEY)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.replicate(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "source", "lang", "text", F.col("__copy").alias("copy"), F.col("__order").alias("shuffle_key"))


def op10_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50, whole, against all documents."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, asked, k=10)


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), new_dir(spark, "warc"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, those marked by their id checked with a changed text."""
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.marked(F.col("doc_id")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_quality_gam": op4_quality_gam,
        "op5_quality_rules": op5_quality_rules,
        "op6_token_rollup": op6_token_rollup,
        "op7_pii_surrogates": op7_pii_surrogates,
        "op8_token_shards": op8_token_shards,
        "op9_source_mixing": op9_source_mixing,
        "op10_bm25_search": op10_bm25_search,
        "op11_warc_archives": op11_warc_archives,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.oracle_sql(), "op9_source_mixing": mixing.oracle_sql(), "op11_warc_archives": warc.oracle_sql(), "op12_merkle_manifest": merkle.oracle_sql(), "op13_prefix_trie": prefix_trie.oracle_sql()}
