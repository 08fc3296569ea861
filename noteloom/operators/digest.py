"""The vault digest: open tasks by due date, status counts, orphans, recent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions.dynamic import get, string
from noteloom.operators.graph import orphans
from noteloom.operators.tasks import list_tasks


def due_bucket(due, today: str):
    """'overdue', 'today', 'upcoming' or 'undated'."""
    return F.when(due.isNull(), "undated").when(due < today, "overdue").when(due == today, "today").otherwise("upcoming")


def status_counts(notes: DataFrame) -> DataFrame:
    """(name, n): how many notes have each status, of any type."""
    value = get(F.col("frontmatter"), "status")
    return notes.select(F.coalesce(string(value), F.to_json(value)).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))


def digest(notes: DataFrame, audit: DataFrame, today: str, recent: int = 5) -> DataFrame:
    """(section, name, value) rows: counts of open tasks, counts by status of any type, orphans, the latest writes."""
    open_tasks = list_tasks(notes, done=False, limit=2_147_483_647)
    tasks = open_tasks.groupBy(due_bucket(F.col("due"), today).alias("name")).agg(F.count("*").cast("string").alias("value"))
    counts = status_counts(notes).select("name", F.col("n").cast("string").alias("value"))
    alone = orphans(notes).select(F.col("note_id").alias("name"), F.col("title").alias("value"))
    writes = audit.orderBy(F.desc("ts"), F.desc("version_id")).limit(recent).select(F.col("version_id").alias("name"), F.concat_ws(" ", "action", "ts").alias("value"))
    parts = {"open_tasks": tasks, "status": counts, "orphans": alone, "recent": writes}
    out = None
    for section, part in parts.items():
        rows = part.select(F.lit(section).alias("section"), "name", "value")
        out = rows if out is None else out.union(rows)
    return out
