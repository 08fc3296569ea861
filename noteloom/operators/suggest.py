"""Link suggestions: notes that one should link to and doesn't yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from noteloom.functions.text import basename, estimate_tokens, mentions, query_buckets, query_tokens, snippet, token_list
from noteloom.operators.budget import greedy
from noteloom.operators.graph import resolve
from noteloom.operators.search import MIN_SIMILARITY, Ranking, SearchIndex
from noteloom.sources.places import checkpointed

TOP_K, MIN_SCORE = 5, 0.15
# The weights of the score, and the number of shared tags that counts in full.
MENTION, SIMILARITY, TAGS, BACKLINK, TAG_CAP = 0.45, 0.30, 0.15, 0.10, 3


def suggest_links(
    notes: DataFrame, note_id: str, top_k: int | None = TOP_K, min_score: float | None = MIN_SCORE, token_budget: int | None = None, index: Ranking | None = None
) -> DataFrame:
    """(note_id, title, score, reasons, snippet, token_count) for the note ``note_id``, best first, ties by id.

    A mention's snippet shows the source where the link would go, any other one the candidate.
    """
    index = index or SearchIndex(notes)
    mine = notes.where(F.col("id") == note_id).select("title", "content", "tags").first()
    if mine is None:
        mine = Row(title=None, content=None, tags=None)
    near = checkpointed(_edges_of(notes, note_id))
    rest = notes.where(F.col("id") != note_id).select("id", "title", "tags")
    open_ = rest.join(near.where(F.col("src") == note_id).select(F.col("dst").alias("id")), "id", "left_anti")
    back = near.where(F.col("dst") == note_id).select(F.col("src").alias("id"), F.lit(True).alias("back"))
    # the note's vector comes from its own text, as literals: at most DIMENSIONS of them
    words = query_tokens(f"{mine.title or ''} {mine.content or ''}")
    similar = index.similar(query_buckets(words))
    content, tags = F.lit(mine.content).cast("string"), F.lit(mine.tags) if mine.tags else F.array().cast("array<string>")
    told = token_list(mine.content or "")
    s_tokens = F.lit(told) if told else F.array().cast("array<string>")
    both = open_.join(back, "id", "left").join(similar, "id", "left").withColumn("s_tags", tags)
    facts = both.select(
        "id", "title",
        mentions(s_tokens, "title", basename("id")).alias("mentioned"),
        F.coalesce("sim", F.lit(0.0)).alias("sim"),
        F.size(F.array_intersect("tags", "s_tags")).alias("shared"),
        F.coalesce("back", F.lit(False)).alias("back"),
    )
    score = (
        F.when(F.col("mentioned"), F.lit(MENTION)).otherwise(F.lit(0.0))
        + SIMILARITY * F.col("sim")
        + TAGS * (F.least("shared", F.lit(TAG_CAP)) / TAG_CAP)
        + F.when(F.col("back"), F.lit(BACKLINK)).otherwise(F.lit(0.0))
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("mentioned"), F.lit("title_mentioned")),
            F.when(F.col("sim") >= MIN_SIMILARITY, F.lit("semantic")),
            F.when(F.col("shared") > 0, F.lit("shared_tags")),
            F.when(F.col("back"), F.lit("backlink")),
        )
    )
    order = [F.desc("score"), F.asc("note_id")]
    scored = facts.select(F.col("id").alias("note_id"), "title", "mentioned", score.alias("score"), reasons.alias("reasons"))
    best = scored.where(F.col("score") >= (MIN_SCORE if min_score is None else min_score)).orderBy(*order).limit(TOP_K if top_k is None else top_k)
    # contents are read for the best only, which are few
    best = checkpointed(best).join(notes.select(F.col("id").alias("note_id"), F.col("content").alias("theirs")), "note_id")
    shown = F.when(F.col("mentioned"), snippet(F.col("title"), content)).otherwise(snippet(F.lit(mine.title).cast("string"), "theirs"))
    made = checkpointed(best.select("note_id", "title", "score", "reasons", shown.alias("snippet")))
    return greedy(made.withColumn("token_count", estimate_tokens("snippet")), token_budget, "token_count", order).orderBy(*order)


def _edges_of(notes: DataFrame, note_id: str) -> DataFrame:
    """(src, dst) of the links from and to one note: only links that may be such are resolved."""
    name = F.lower(basename(F.lit(note_id)))
    spread = notes.select(F.col("id").alias("src"), F.explode("links.target").alias("target"))
    maybe = spread.where((F.col("src") == note_id) | (F.col("target") == note_id) | (F.lower("target") == name))
    return resolve(maybe, notes.select("id")).where("dst IS NOT NULL AND dst <> src").select("src", "dst").distinct()
