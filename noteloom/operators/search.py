"""Ranked search over notes: lexical, semantic and hybrid, cut by top-k and token budget."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import estimate_tokens, query_buckets, query_tokens, snippet, tokenize
from noteloom.operators.budget import greedy
from noteloom.operators.postings import bucket_postings, literal_counts, token_counts
from noteloom.sources.places import checkpointed, written

MODES = ("hybrid", "lexical", "semantic")
MIN_SIMILARITY = 0.15


def mode_of(name: str | None) -> str:
    """A known mode, else hybrid."""
    return name if name in MODES else "hybrid"


class Ranking:
    """Ranked search over something that gives (id, lex) of a query, (id, sim) of a sparse vector, and the texts of hits."""

    spark: SparkSession

    def lexical(self, query: str) -> DataFrame:
        raise NotImplementedError

    def similar(self, counts: Counter[int]) -> DataFrame:
        raise NotImplementedError

    def _shown(self, hits: DataFrame, few: bool) -> DataFrame:
        """``hits`` (note_id, score) with title and content; ``few`` hits can be named one by one."""
        raise NotImplementedError

    def semantic(self, query: str) -> DataFrame:
        """(id, sim): cosine of the hashed vectors, from integer sums and one division; only rows above 0."""
        return self.similar(query_buckets(query_tokens(query)))

    def ranked(self, query: str, mode: str = "hybrid") -> DataFrame:
        """(id, score) of all hits."""
        mode = mode_of(mode)
        if mode == "lexical":
            return self.lexical(query).select("id", F.col("lex").cast("double").alias("score"))
        if mode == "semantic":
            return self.semantic(query).where(F.col("sim") >= MIN_SIMILARITY).select("id", F.col("sim").alias("score"))
        sem, lex = self.semantic(query), self.lexical(query)
        both = lex.join(sem, "id", "full_outer").select("id", F.coalesce("lex", F.lit(0)).alias("lex"), F.coalesce("sim", F.lit(0.0)).alias("sim"))
        hits = checkpointed(both.where((F.col("lex") > 0) | (F.col("sim") >= MIN_SIMILARITY)))
        scored = hits.join(F.broadcast(hits.agg(F.max("lex").alias("most"))), F.lit(True))
        share = F.when(F.col("most") > 0, F.col("lex").cast("double") / F.col("most")).otherwise(F.lit(0.0))
        return scored.select("id", (0.5 * share + 0.5 * F.col("sim")).alias("score"))

    def search(self, query: str, mode: str = "hybrid", token_budget: int | None = None, top_k: int | None = None) -> DataFrame:
        """(note_id, title, score, snippet, token_count), best first, ties by id.

        The cut to top_k comes before the budget, and what the budget skips isn't filled up.
        """
        order = [F.desc("score"), F.asc("note_id")]
        hits = self.ranked(query, mode).withColumnRenamed("id", "note_id")
        if top_k is not None:
            hits = checkpointed(hits.orderBy(*order).limit(top_k))
        made = self._shown(hits, top_k is not None)
        shown = made.select("note_id", "title", "score", snippet(F.lit(query), "content").alias("snippet"))
        priced = shown.withColumn("token_count", estimate_tokens("snippet"))
        if top_k is not None and token_budget is not None:
            priced = checkpointed(priced)  # at most top_k rows, which the fold reads twice
        return greedy(priced, token_budget, "token_count", order).orderBy(*order)


class SearchIndex(Ranking):
    """Postings of a table of notes (id, title, content), made from the texts in each query; ``StoredIndex`` keeps them.

    Scored text is the title, a space and the content. Texts are dealt by id once, so the counts of tokens, of
    buckets and of notes need no further shuffle where the vocabulary is small enough to be broadcast.
    """

    def __init__(self, notes: DataFrame):
        self.spark = notes.sparkSession
        self.notes = notes.select("id", "title", "content")
        self.texts = scored_texts(self.notes)
        self.counts = token_counts(self.texts.repartition("id"))
        self.vectors = bucket_postings(self.counts)

    def lexical(self, query: str) -> DataFrame:
        """(id, lex): sum over query tokens, repeats included, of their counts; only rows above 0.

        The query's tokens are literals; other tokens are dropped before anything is shuffled.
        """
        q = F.broadcast(literal_counts(self.spark, query_tokens(query), "token", "q"))
        words = self.texts.select("id", F.explode(tokenize("text")).alias("token"))
        return words.join(q, "token").groupBy("id").agg(F.sum("q").alias("lex"))

    def similar(self, counts: Counter[int]) -> DataFrame:
        """(id, sim) for one sparse vector: at most DIMENSIONS buckets, which bounds the broadcast.

        Dot product and length of a note come from one pass over its buckets.
        """
        vector = F.broadcast(literal_counts(self.spark, counts, "bucket", "qtf"))
        both = self.vectors.join(vector, "bucket", "left").groupBy("id")
        sums = both.agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"), F.sum(F.col("tf") * F.col("tf")).alias("squared"))
        return cosines(sums, counts)

    def _shown(self, hits: DataFrame, few: bool) -> DataFrame:
        return hits.join(self.notes.withColumnRenamed("id", "note_id"), "note_id")


def scored_texts(notes: DataFrame) -> DataFrame:
    """(id, text): what of a note is scored."""
    return notes.select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("text"))


def cosines(sums: DataFrame, counts: Counter[int]) -> DataFrame:
    """(id, sim) from (id, dot, squared) and the query's own counts; only rows above 0."""
    length = F.sqrt(F.lit(sum(n * n for n in counts.values())).cast("double"))
    return sums.where("dot > 0").select("id", (F.col("dot") / (length * F.sqrt(F.col("squared").cast("double")))).alias("sim"))


def best_notes(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): the best text (id, text) of each query (query_id, text) by lexical score, ties by id.

    Many queries at once. Texts are dealt by id once, so counts and scores need no shuffle of postings, and of the scores only the
    best of each part is shuffled. The queries' counts are written first: their size is then known, and a small table is broadcast.
    """
    asked = written(token_counts(queries, "query_id", "text").select(F.col("id").alias("query_id"), "token", F.col("n").alias("q")), "asked")
    held = token_counts(texts.select("id", "text").repartition("id"))
    scores = held.join(asked, "token").groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("n")).alias("score"))
    best = scores.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("id")).alias("d"))).alias("b"))
    return best.select("query_id", (-F.col("b.d")).alias("id"), F.col("b.score").alias("score"))


def dense_top_k(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score) of the k rows nearest to one dense unit vector (a one-row table), ties by id."""
    q = F.broadcast(query.select(F.col(vec_col).alias("__q")).limit(1))
    dot = F.aggregate(F.zip_with(F.col(vec_col), F.col("__q"), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return vectors.join(q, F.lit(True)).select(F.col(id_col).alias("id"), dot.alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(k)
