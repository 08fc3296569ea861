"""Retrieval quality: precision, recall, F1 and token efficiency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prf(retrieved: DataFrame, relevant: DataFrame, by: list[str], item: str = "id") -> DataFrame:
    """(by..., precision, recall, f1) of two tables of distinct (by..., item).

    Nothing retrieved has precision 1 if nothing was relevant, else 0; nothing relevant has recall 1.
    """
    a = retrieved.select(*by, item).distinct().withColumn("__r", F.lit(1))
    b = relevant.select(*by, item).distinct().withColumn("__w", F.lit(1))
    both = a.join(b, [*by, item], "full_outer")
    sums = both.groupBy(*by).agg(
        F.sum(F.coalesce("__r", F.lit(0))).alias("got"), F.sum(F.coalesce("__w", F.lit(0))).alias("want"), F.sum(F.coalesce(F.col("__r") * F.col("__w"), F.lit(0))).alias("hit")
    )
    return sums.select(*by, *scores(F.col("got"), F.col("want"), F.col("hit")))


def scores(got, want, hit) -> list:
    """Columns precision, recall, f1 from counts."""
    precision = F.when(got > 0, hit / got).otherwise(F.when(want == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    recall = F.when(want > 0, hit / want).otherwise(F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def token_efficiency(hits: DataFrame, relevant: DataFrame, by: list[str], item: str = "id", cost: str = "token_count") -> DataFrame:
    """(by..., efficiency): the share of tokens spent on relevant items; 1 where none were spent."""
    marked = hits.join(relevant.select(*by, item).distinct().withColumn("__w", F.lit(True)), [*by, item], "left")
    sums = marked.groupBy(*by).agg(F.sum(cost).alias("all_t"), F.sum(F.when(F.col("__w"), F.col(cost)).otherwise(0)).alias("good_t"))
    return sums.select(*by, F.when(F.col("all_t") > 0, F.col("good_t") / F.col("all_t")).otherwise(F.lit(1.0)).alias("efficiency"))


def averages(per_scenario: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of means."""
    return per_scenario.agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics])


def run_suite(spark: SparkSession, scenarios: list[dict], retriever: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    """(name, precision, recall, f1, efficiency, tokens) of scenarios.

    A scenario has name, query, notes (id -> content), relevant ids, and optionally token_budget and top_k. The
    retriever takes (notes, scenario) and returns (note_id, token_count).
    """
    out = None
    for s in scenarios:
        notes = spark.createDataFrame([(k, f"{k}.md", k.rsplit("/", 1)[-1], v) for k, v in s["notes"].items()], "id string, path string, title string, content string")
        hits = retriever(notes, s).select(F.lit(s["name"]).alias("name"), F.col("note_id").alias("id"), "token_count")
        out = hits if out is None else out.union(hits)
    want = spark.createDataFrame([(s["name"], r) for s in scenarios for r in s["relevant"]], "name string, id string")
    names = spark.createDataFrame([(s["name"],) for s in scenarios], "name string")
    spent = out.groupBy("name").agg(F.sum("token_count").alias("tokens"))
    scored = names.join(prf(out, want, ["name"]), "name", "left").join(token_efficiency(out, want, ["name"]), "name", "left").join(spent, "name", "left")
    return scored.na.fill({"precision": 1.0, "recall": 1.0, "f1": 1.0, "efficiency": 1.0, "tokens": 0})
