"""Embeddings: an embedder's protocol, the hashing embedder, and a cache keyed by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import DIMENSIONS
from noteloom.operators.postings import bucket_postings, norms, token_counts
from noteloom.sources.places import Files


class Embedder(Protocol):
    """Something that adds a unit vector to texts."""

    dim: int

    def embed(self, texts: DataFrame) -> DataFrame:
        """(id, vector array<double>) of (id, text); a text without features has zeros."""


class HashingEmbedder:
    """Feature hashing, all in the JVM."""

    dim = DIMENSIONS

    def embed(self, texts: DataFrame) -> DataFrame:
        post = bucket_postings(token_counts(texts))
        unit = post.join(norms(post), "id").select("id", "bucket", (F.col("tf") / F.sqrt(F.col("squared").cast("double"))).alias("w"))
        sparse = unit.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
        return texts.select("id").join(sparse, "id", "left").select("id", F.coalesce(F.when(F.col("m").isNotNull(), dense), F.array_repeat(F.lit(0.0), self.dim)).alias("vector"))


class BatchEmbedder:
    """A model behind a function of text batches, for remote or neural embedders.

    The function gets a list of texts and returns a vector each; a batch that fails gets zero vectors.
    """

    def __init__(self, dim: int, function: Callable[[list[str]], list[list[float]]], batch: int = 64):
        self.dim, self.function, self.batch = dim, function, batch

    def embed(self, texts: DataFrame) -> DataFrame:
        dim, function, size = self.dim, self.function, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out: list[list[float]] = []
                items = pdf["text"].fillna("").tolist()
                for lo in range(0, len(items), size):
                    part = items[lo : lo + size]
                    try:
                        got = function(part)
                        if len(got) != len(part) or any(len(v) != dim for v in got):
                            raise ValueError("wrong shape")
                    except Exception:  # an embedder that fails must not fail the search
                        got = [[0.0] * dim for _ in part]
                    out += got
                yield pd.DataFrame({"id": pdf["id"], "vector": out})

        kind = dict(texts.dtypes)["id"]
        return texts.select("id", "text").mapInPandas(run, f"id {kind}, vector array<double>")


class VectorCache:
    """Vectors by content hash in a shared folder; only texts not seen before are embedded."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder
        self.files = Files(spark, self.root)

    def _stored(self) -> DataFrame:
        names = [f"{self.root}/{n}" for n in self.files.names() if n.startswith("part-of-")]
        schema = "hash string, vector array<double>"
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def embed(self, texts: DataFrame) -> DataFrame:
        """(id, vector) of (id, text), embedding and storing what is missing, each distinct text once."""
        keyed = texts.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
        fresh = keyed.dropDuplicates(["hash"]).select(F.col("hash").alias("id"), "text").join(self._stored().select(F.col("hash").alias("id")), "id", "left_anti")
        n = len(self.files.names())
        self.embedder.embed(fresh).select(F.col("id").alias("hash"), "vector").write.parquet(f"{self.root}/part-of-{n:08d}")
        return keyed.join(self._stored().dropDuplicates(["hash"]), "hash").select("id", "vector")
