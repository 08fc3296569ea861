"""Notes as callers see them: lists and progressive disclosure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import estimate_tokens, truncate_words
from noteloom.functions.yamlio import dump_mapping

FORMATS = ("outline", "frontmatter_only", "full")


def list_notes(notes: DataFrame) -> DataFrame:
    """(note_id, title, path) by id."""
    return notes.select(F.col("id").alias("note_id"), "title", "path").orderBy("note_id")


def outline(headings: Column) -> Column:
    """Headings as an indented list."""
    return F.array_join(F.transform(headings, lambda h: F.concat(F.repeat(F.lit("  "), h.level - 1), F.lit("- "), h.text)), "\n")


def get_notes(notes: DataFrame, format: str | None = "outline", max_tokens: int | None = None) -> DataFrame:
    """(note_id, title, format, content, token_count, truncated) of each row; unknown formats mean outline.

    Filter ``notes`` by id first to get one.
    """
    shape = format if format in FORMATS else "outline"
    if shape == "outline":
        content = outline(F.col("headings"))
    elif shape == "full":
        content = F.col("content")
    else:
        content = F.regexp_replace(dump_mapping(F.to_json("frontmatter")), r"\s+$", "")
    made = notes.select(F.col("id").alias("note_id"), "title", F.lit(shape).alias("format"), F.coalesce(content, F.lit("")).alias("whole"))
    if max_tokens is None:
        shown = made.select("note_id", "title", "format", F.col("whole").alias("content"), F.lit(False).alias("truncated"))
    else:
        shown = made.select("note_id", "title", "format", truncate_words("whole", max_tokens).alias("content"), (F.length("whole") > max_tokens * 4).alias("truncated"))
    return shown.select("note_id", "title", "format", "content", estimate_tokens("content").alias("token_count"), "truncated")
