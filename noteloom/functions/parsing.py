"""Markdown notes as columns: frontmatter, headings, links, tags, title, tasks, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import estimate_tokens
from noteloom.functions.yamlio import parse_mapping

HEADING = r"(?U)^(#{1,6})\s+(\S.*?)\s*$"
LINK = r"\[\[([^\]]+)\]\]"
TAG = r"(?U)(?:^|\s)#([A-Za-z0-9_/-]+)"
TASK = r"(?U)^\s*[-*] \[([ xX])\] (.*)$"
DUE = r"(?:due:|\x{1F4C5}[\t\n\x0B\f\r \u0085 ]*)(\d{4}-\d{2}-\d{2})"
PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"
BUILTIN_VARS = ("date", "time", "datetime")
#: Estimated tokens of a task beyond its text.
TASK_OVERHEAD = 8


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _has_block(raw: Column) -> Column:
    return F.startswith(raw, F.lit("---\n")) & (_block_end(raw) > 0)


def _block_end(raw: Column) -> Column:
    """Place (from 1) of the newline before the closing dashes, 0 if there is none."""
    return F.locate("\n---", raw, 4)


def frontmatter_block(raw: Column | str) -> Column:
    """The YAML text between the dashes; null without a block. Only \\n line ends count."""
    r = _col(raw)
    return F.when(_has_block(r), F.substring(r, F.lit(5), F.greatest(_block_end(r) - 5, F.lit(0))))


def body(raw: Column | str) -> Column:
    """What follows the block, without one newline after the closing dashes."""
    r = _col(raw)
    rest = F.substring(r, _block_end(r) + 4, F.length(r))
    return F.when(_has_block(r), F.when(F.startswith(rest, F.lit("\n")), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)).otherwise(r)


def lines(text: Column | str) -> Column:
    """Lines without their ends (\\n or \\r\\n); a final line end opens no further line."""
    t = F.coalesce(_col(text), F.lit(""))
    parts = F.transform(F.split(t, "\n", -1), lambda s: F.regexp_replace(s, "\r$", ""))
    return F.when(F.endswith(t, F.lit("\n")) | (t == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slugify(text: Column | str) -> Column:
    """Lower-case ASCII letters and digits, other runs as one dash, no dash at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def headings(text: Column | str) -> Column:
    """array<struct<level, text, slug>> of heading lines."""
    found = F.filter(lines(text), lambda s: s.rlike(HEADING))
    return F.transform(
        found,
        lambda s: F.struct(
            F.length(F.regexp_extract(s, HEADING, 1)).alias("level"),
            F.regexp_extract(s, HEADING, 2).alias("text"),
            slugify(F.regexp_extract(s, HEADING, 2)).alias("slug"),
        ),
    )


def links(text: Column | str) -> Column:
    """array<struct<target, heading, block, alias, raw>> of wikilinks, in order."""

    def one(inner: Column) -> Column:
        place = F.regexp_extract(inner, r"^([^|]*)", 1)
        alias = F.when(F.contains(inner, F.lit("|")), F.btrim(F.regexp_extract(inner, r"(?s)^[^|]*\|(.*)$", 1)))
        target = F.btrim(F.substring_index(place, "#", 1))
        anchor = F.when(F.contains(place, F.lit("#")), F.btrim(F.regexp_extract(place, r"(?s)^[^#]*#(.*)$", 1)))
        is_block = F.startswith(anchor, F.lit("^"))
        return F.struct(
            target.alias("target"),
            F.when(anchor.isNotNull() & ~is_block, anchor).alias("heading"),
            F.when(is_block, F.substring(anchor, F.lit(2), F.length(anchor))).alias("block"),
            alias.alias("alias"),
            F.concat(F.lit("[["), inner, F.lit("]]")).alias("raw"),
        )

    return F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(LINK), F.lit(1)), one)


def inline_tags(text: Column | str) -> Column:
    """Tags written as #tag, in order; a tag starts the text or follows white space."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TAG), F.lit(1))


def frontmatter_tags(properties: Column) -> Column:
    """Tags of the property 'tags': the strings of a list, or a text cut at commas, spaces and tabs."""
    value = F.try_variant_get(properties, "$.tags", "variant")
    items = F.try_variant_get(value, "$", "array<variant>")
    strings = F.transform(
        F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")
    )
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    cut = F.filter(F.split(text, "[, \t]+"), lambda t: t != "")
    return F.coalesce(F.when(F.schema_of_variant(value).startswith("ARRAY"), strings), cut, F.array().cast("array<string>"))


def title(properties: Column, heads: Column, note_id: Column) -> Column:
    """The text property 'title', else the first heading of level 1, else the id's last part."""
    value = F.try_variant_get(properties, "$.title", "variant")
    named = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    first = F.element_at(F.filter(heads, lambda h: h.level == 1), 1)
    return F.coalesce(named, F.when(F.size(F.filter(heads, lambda h: h.level == 1)) > 0, first.text), F.substring_index(note_id, "/", -1))


def parse_notes(raw_notes: DataFrame) -> DataFrame:
    """Notes (id, path, title, frontmatter, content, headings, links, tags, raw) of (path, raw) rows.

    Null raw counts as empty. The YAML function runs once, on the frontmatter block.
    """
    r = F.coalesce("raw", F.lit(""))
    base = raw_notes.select("path", r.alias("raw"))
    split = base.select("path", "raw", F.regexp_replace("path", r"\.md$", "").alias("id"), frontmatter_block("raw").alias("block"), body("raw").alias("content"))
    typed = split.select("id", "path", "content", "raw", F.try_parse_json(parse_mapping(F.col("block"))).alias("frontmatter"))
    rich = typed.withColumn("headings", headings("content")).withColumn("links", links("content"))
    tags = F.array_distinct(F.concat(frontmatter_tags(F.col("frontmatter")), inline_tags("content")))
    return rich.select(
        "id", "path", title(F.col("frontmatter"), F.col("headings"), F.col("id")).alias("title"), "frontmatter", "content", "headings", "links", tags.alias("tags"), "raw"
    )


def tasks(notes: DataFrame) -> DataFrame:
    """(note_id, line, text, done, due, tags, token_count) of each checklist line of notes (id, content)."""
    rows = notes.select(F.col("id").alias("note_id"), F.posexplode(lines("content")).alias("line", "row")).where(F.col("row").rlike(TASK))
    text = F.regexp_replace(F.regexp_extract("row", TASK, 2), r"(?U)\s+$", "")
    made = rows.select("note_id", "line", text.alias("text"), (F.regexp_extract("row", TASK, 1) != " ").alias("done"))
    due = F.regexp_extract("text", DUE, 1)
    return made.select(
        "note_id", "line", "text", "done", F.when(due != "", due).alias("due"), inline_tags("text").alias("tags"),
        (estimate_tokens("text") + TASK_OVERHEAD).alias("token_count"),
    )


def template_vars(raw: Column | str) -> Column:
    """Distinct placeholder names in order of appearance, without those filled by the engine."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(_col(raw), F.lit("")), F.lit(PLACEHOLDER), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(v) for v in BUILTIN_VARS]))
