"""Typed memories with provenance: validation, storing, recall, conflicts."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.errors import EngineError
from noteloom.functions.text import estimate_tokens, memory_seed, query_tokens, stable_id, tokenize
from noteloom.operators.budget import greedy
from noteloom.operators.postings import literal_counts

TYPES = ("user", "feedback", "project", "reference")
AUTHORS = ("human", "agent")
SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("content", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("key", T.StringType()),
        T.StructField("source", T.StructType([T.StructField("origin", T.StringType()), T.StructField("author", T.StringType()), T.StructField("timestamp", T.StringType())])),
        T.StructField("ttl", T.LongType()),
    ]
)


def memory_of(args: dict[str, Any]) -> dict[str, Any]:
    """A valid memory with its id; checks run in the order source, type, author, content, origin."""
    source = args.get("source")
    if not isinstance(source, dict):
        raise EngineError("MISSING_PROVENANCE", "A memory needs a source.", "Pass source with origin and author.")
    if args.get("type") not in TYPES:
        raise EngineError("INVALID_TYPE", f"Unknown memory type {args.get('type')!r}.", f"Use one of {', '.join(TYPES)}.")
    if source.get("author") not in AUTHORS:
        raise EngineError("INVALID_INPUT", f"Unknown author {source.get('author')!r}.", f"Use one of {', '.join(AUTHORS)}.")
    if not str(args.get("content") or "").strip():
        raise EngineError("INVALID_INPUT", "A memory's content can't be empty.", "Pass what should be remembered.")
    if not str(source.get("origin") or "").strip():
        raise EngineError("MISSING_PROVENANCE", "A source's origin can't be empty.", "Say where the fact comes from.")
    seed = f"{args['type']} {args.get('key') or ''} {args['content']} {source['origin']} {source['author']}"
    return {
        "id": "mem_" + hashlib.sha256(seed.encode()).hexdigest()[:16],
        "type": args["type"],
        "content": args["content"],
        "tags": list(args.get("tags") or []),
        "key": args.get("key"),
        "source": {"origin": source["origin"], "author": source["author"], "timestamp": source.get("timestamp") or datetime.now(UTC).isoformat().replace("+00:00", "Z")},
        "ttl": args.get("ttl"),
    }


def error_code(kind: Column, author: Column, content: Column, origin: Column, has_source: Column) -> Column:
    """The first error of a row of memory fields, null if it is valid; the order of ``memory_of``."""
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    return (
        F.when(~F.coalesce(has_source, F.lit(False)), "MISSING_PROVENANCE")
        .when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), "INVALID_TYPE")
        .when(~F.coalesce(author.isin(*AUTHORS), F.lit(False)), "INVALID_INPUT")
        .when(blank(content), "INVALID_INPUT")
        .when(blank(origin), "MISSING_PROVENANCE")
    )


def with_ids(memories: DataFrame) -> DataFrame:
    """Memories with their ids derived anew."""
    seed = memory_seed("type", "key", "content", "source.origin", "source.author")
    return memories.withColumn("id", stable_id(seed, "mem"))


def valid(memories: DataFrame) -> DataFrame:
    """Rows that pass validation; bulk loads drop the others."""
    code = error_code(F.col("type"), F.col("source.author"), F.col("content"), F.col("source.origin"), F.col("source").isNotNull())
    return memories.where(code.isNull())


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored memories with the fresh ones laid over them by id; of equal fresh ids the latest timestamp stays."""
    tagged = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    newest = Window.partitionBy("id").orderBy(F.desc("__new"), F.desc("source.timestamp"), F.asc("content"))
    return tagged.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r", "__new")


def forget(stored: DataFrame, memory_id: str) -> DataFrame:
    """Stored memories without one."""
    return stored.where(~F.col("id").eqNullSafe(F.lit(memory_id)))


def lexical_scores(texts: DataFrame, query: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, score) of texts that hold a query token; each token counts as often as the query repeats it."""
    q = literal_counts(texts.sparkSession, query_tokens(query), "token", "q")
    words = texts.select(F.col(id_col).alias("id"), F.explode(tokenize(text_col)).alias("token"))
    return words.join(F.broadcast(q), "token").groupBy("id").agg(F.sum("q").alias("score"))


def rank(memories: DataFrame, query: str) -> DataFrame:
    """All memories with their score, those without a hit at 0, best first, ties by id."""
    scored = memories.join(lexical_scores(memories, query), "id", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
    return scored.orderBy(F.desc("score"), F.asc("id"))


def conflicts(memories: DataFrame) -> DataFrame:
    """(key, memory_ids) of keys that stand for more than one content; null keys are left out."""
    keyed = memories.where("key IS NOT NULL").groupBy("key").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.collect_set("id").alias("ids"))
    return keyed.where("lo <> hi").select("key", F.sort_array("ids").alias("memory_ids"))


def live(memories: DataFrame, now: str) -> DataFrame:
    """Memories whose ttl (seconds from their timestamp) has not run out at ``now``; an opt-in filter."""
    end = F.unix_timestamp(F.try_to_timestamp("source.timestamp")) + F.col("ttl")
    return memories.where(F.col("ttl").isNull() | F.coalesce(end > F.unix_timestamp(F.try_to_timestamp(F.lit(now))), F.lit(True)))


def recall(memories: DataFrame, query: str, kind: str | None = None, token_budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, conflicts): ranked memories that hold a query token, within the budget, and the conflicts
    among all ranked ones, those that the budget cut included. Unknown types filter nothing."""
    chosen = memories.where(F.col("type") == kind) if kind in TYPES else memories
    hits = chosen.join(lexical_scores(chosen, query), "id").withColumn("token_count", estimate_tokens("content"))
    order = [F.desc("score"), F.asc("id")]
    return greedy(hits, token_budget, "token_count", order).orderBy(*order), conflicts(hits).orderBy("key")
