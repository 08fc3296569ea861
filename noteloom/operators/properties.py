"""Structured queries over dynamic properties."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions.dynamic import Filter, get, sort_keys
from noteloom.functions.text import estimate_tokens
from noteloom.operators.budget import greedy

LIMIT = 50


def properties_query(
    notes: DataFrame,
    filters: list[Filter] | None = None,
    select: list[str] | None = None,
    sort_by: str | None = None,
    descending: bool = False,
    limit: int | None = LIMIT,
    token_budget: int | None = None,
) -> DataFrame:
    """(note_id, title, properties, token_count) of notes (id, title, frontmatter) that pass all filters.

    Missing sort values come last ascending and first descending; ties go by id, ascending both ways. The limit
    comes before the projection and the budget. ``properties`` is JSON text of the chosen keys that
    are present.
    """
    fm = F.col("frontmatter")
    chosen = notes.where(reduce(and_, [f.column(fm) for f in filters], F.lit(True))) if filters else notes
    order = []
    if sort_by:
        keys = sort_keys(fm, sort_by)
        order = [k.desc_nulls_first() if descending else k.asc_nulls_last() for k in keys]
    names = [f"__s{i}" for i in range(len(order))]
    if sort_by:
        chosen = chosen.select("id", "title", "frontmatter", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
        order = [F.col(n).desc_nulls_first() if descending else F.col(n).asc_nulls_last() for n in names]
    order = [*order, F.col("note_id").asc()]
    rows = chosen.withColumnRenamed("id", "note_id").orderBy(*order)
    rows = rows.limit(LIMIT if limit is None else limit)
    if select is None:
        shown = F.to_json(fm)
    else:
        entries = [F.when(get(fm, k).isNotNull(), F.concat(F.lit(_quoted(k) + ":"), F.to_json(get(fm, k)))) for k in dict.fromkeys(select)]
        shown = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*entries)), ","), F.lit("}")) if entries else F.lit("{}")
    made = rows.select("note_id", "title", shown.alias("properties"), *names)
    cost = estimate_tokens(F.concat(F.lit('{"note_id":'), F.to_json(F.struct("note_id")), F.lit("}"), "properties"))
    priced = made.withColumn("token_count", cost)
    return greedy(priced, token_budget, "token_count", order).orderBy(*order).select("note_id", "title", "properties", "token_count")


def _quoted(key: str) -> str:
    import json

    return json.dumps(key, ensure_ascii=False)
