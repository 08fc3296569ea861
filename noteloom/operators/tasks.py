"""Checklist tasks: queries and the guarded toggle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.errors import EngineError
from noteloom.functions.parsing import tasks
from noteloom.operators.budget import greedy

LIMIT = 100
_LINE = re.compile(r"^(\s*[-*] \[)([ xX])(\] )(.*)$", re.S)


def list_tasks(
    notes: DataFrame,
    done: bool | None = None,
    due_before: str | None = None,
    due_after: str | None = None,
    tag: str | None = None,
    note_id: str | None = None,
    limit: int | None = LIMIT,
    token_budget: int | None = None,
) -> DataFrame:
    """Tasks by due date (undated last), note and line.

    ``due_before`` is strict, ``due_after`` includes its day; either leaves undated tasks out. The note filter
    comes before parsing.
    """
    found = tasks(notes.where(F.col("id") == note_id) if note_id is not None else notes)
    if done is not None:
        found = found.where(F.col("done") == done)
    if due_before is not None:
        found = found.where(F.col("due") < due_before)
    if due_after is not None:
        found = found.where(F.col("due") >= due_after)
    if tag is not None:
        found = found.where(F.array_contains("tags", tag))
    order = [F.col("due").asc_nulls_last(), F.asc("note_id"), F.asc("line")]
    cut = found.orderBy(*order).limit(LIMIT if limit is None else limit)
    return greedy(cut, token_budget, "token_count", order).orderBy(*order)


def toggle_line(content: str, line: int, expect_text: str) -> str:
    """The content with one task's box flipped, if the line still is the task with that text."""
    parts = content.split("\n")
    found = _LINE.match(parts[line].removesuffix("\r")) if 0 <= line < len(parts) else None
    if not found or found[4].rstrip() != expect_text.strip():
        raise EngineError("CONFLICT", f"Line {line} is not the task {expect_text!r}.", "List the tasks again and retry.")
    box = "x" if found[2] == " " else " "
    end = "\r" if parts[line].endswith("\r") else ""
    parts[line] = found[1] + box + found[3] + found[4] + end
    return "\n".join(parts)


def toggled(content: Column, line: Column) -> Column:
    """Bulk form: contents with the box of the given line (from 0) flipped."""
    flip = lambda s: F.when(s.rlike(r"(?U)^\s*[-*] \[ \] "), F.regexp_replace(s, r"(?U)^(\s*[-*] \[) (\] )", "$1x$2")).otherwise(
        F.regexp_replace(s, r"(?U)^(\s*[-*] \[)[xX](\] )", "$1 $2")
    )
    return F.array_join(F.transform(F.split(content, "\n", -1), lambda s, i: F.when(i == line, flip(s)).otherwise(s)), "\n")
