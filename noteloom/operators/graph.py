"""The link graph of notes: resolution, links, backlinks, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.errors import EngineError
from noteloom.functions.text import basename

RELATIONS = ("links", "backlinks", "neighbors")


def resolve(targets: DataFrame, notes: DataFrame) -> DataFrame:
    """``targets`` (with a column target) plus dst, the id it stands for, or null.

    A target is an exact id, else the case-insensitive last part of one; of several, the least.
    """
    ids = notes.select(F.col("id").alias("__id"))
    names = notes.groupBy(F.lower(basename("id")).alias("__name")).agg(F.min("id").alias("__by_name"))
    exact = targets.join(ids, F.col("target") == F.col("__id"), "left")
    either = exact.join(names, F.lower(F.col("target")) == F.col("__name"), "left")
    return either.withColumn("dst", F.coalesce("__id", "__by_name")).drop("__id", "__name", "__by_name")


def edges(notes: DataFrame) -> DataFrame:
    """(src, dst, pos): resolved links of each note, the first of each pair, without links to itself."""
    spread = notes.select(F.col("id").alias("src"), F.posexplode("links").alias("pos", "link")).select("src", "pos", F.col("link.target").alias("target"))
    found = resolve(spread, notes).where("dst IS NOT NULL AND dst <> src")
    return found.groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def outgoing(all_edges: DataFrame, note_id: str) -> DataFrame:
    """(note_id, pos) of the notes that one links to, in link order."""
    return all_edges.where(F.col("src") == note_id).select(F.col("dst").alias("note_id"), "pos").orderBy("pos", "note_id")


def incoming(all_edges: DataFrame, note_id: str) -> DataFrame:
    """(note_id) of the notes that link to one."""
    return all_edges.where(F.col("dst") == note_id).select(F.col("src").alias("note_id")).orderBy("note_id")


def neighbors(all_edges: DataFrame, note_id: str, depth: int = 1) -> DataFrame:
    """(note_id, depth) of the notes within ``depth`` steps either way, without the start.

    Each step joins the frontier with the edges and drops what is seen. Steps end early when the frontier is
    empty; the seen set is checkpointed each step, so the plan doesn't grow with the depth.
    """
    spark = all_edges.sparkSession
    both = all_edges.select("src", "dst").union(all_edges.select(F.col("dst"), F.col("src"))).distinct()
    seen = spark.range(1).select(F.lit(note_id).alias("note_id"), F.lit(0).alias("depth"))
    frontier = seen
    for step in range(1, max(1, depth) + 1):
        reached = frontier.join(both, frontier.note_id == both.src).select(F.col("dst").alias("note_id")).distinct()
        fresh = reached.join(seen.select("note_id"), "note_id", "left_anti").select("note_id", F.lit(step).alias("depth"))
        fresh = _cut(fresh) if depth > 1 else fresh
        seen = seen.union(fresh)
        frontier = fresh
        if depth > 1 and fresh.isEmpty():
            break
    return seen.where("depth > 0")


def _cut(df: DataFrame) -> DataFrame:
    from noteloom.sources.places import checkpointed

    return checkpointed(df)


def graph_query(notes: DataFrame, note_id: str, relation: str, depth: int = 1) -> DataFrame:
    """(note_id, title) of a relation; unknown relations are an error."""
    if relation not in RELATIONS:
        raise EngineError("INVALID_INPUT", f"Unknown relation {relation!r}.", f"Use one of {', '.join(RELATIONS)}.")
    all_edges = edges(notes)
    titles = notes.select(F.col("id").alias("note_id"), "title")
    if relation == "links":
        return outgoing(all_edges, note_id).join(titles, "note_id").orderBy("pos", "note_id").select("note_id", "title")
    found = incoming(all_edges, note_id) if relation == "backlinks" else neighbors(all_edges, note_id, depth)
    return found.join(titles, "note_id").select("note_id", "title").orderBy("note_id")


def orphans(notes: DataFrame) -> DataFrame:
    """(note_id, title) of notes that neither link nor are linked to."""
    e = edges(notes)
    touched = e.select(F.col("src").alias("note_id")).union(e.select(F.col("dst").alias("note_id")))
    return notes.select(F.col("id").alias("note_id"), "title").join(touched, "note_id", "left_anti")
