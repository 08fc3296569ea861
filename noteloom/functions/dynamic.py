"""Dynamic properties: values of any JSON type held in VARIANT columns, and predicates over them."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.errors import EngineError

OPS = ("eq", "ne", "contains", "exists", "not_exists", "gt", "lt", "gte", "lte")
_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def path(key: str) -> str:
    """The JSON path of a top-level key, whatever characters it has."""
    if '"' in key:
        raise EngineError("INVALID_INPUT", f"The property key {key!r} holds a quote.", "Use keys without quotes.")
    return f'$["{key}"]'


def kind(value: Column) -> Column:
    """'number', 'string', 'boolean', 'null', 'array' or 'object' of a variant; SQL null if absent."""
    s = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(s.rlike(_NUMBER), "number")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def number(value: Column) -> Column:
    return F.when(kind(value) == "number", F.try_variant_get(value, "$", "double"))


def string(value: Column) -> Column:
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string"))


def get(properties: Column, key: str) -> Column:
    """The value under a key; SQL null if absent, variant null if it is null."""
    return F.try_variant_get(properties, path(key), "variant")


def equal(value: Column, wanted: Any) -> Column:
    """Deep equality, numbers by value; false for an absent value."""
    if isinstance(wanted, bool):
        found = (kind(value) == "boolean") & (F.try_variant_get(value, "$", "boolean") == wanted)
    elif isinstance(wanted, (int, float)):
        found = number(value) == float(wanted)
    elif isinstance(wanted, str):
        found = string(value) == wanted
    elif wanted is None:
        found = kind(value) == "null"
    else:
        # both sides pass through the same printer, which sorts the keys of objects
        printed = F.to_json(F.parse_json(F.lit(json.dumps(wanted, sort_keys=True))))
        found = F.to_json(value) == printed
    return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Filter:
    """One condition on a property."""

    key: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise EngineError("INVALID_INPUT", f"Unknown filter op {self.op!r}.", f"Use one of {', '.join(OPS)}.")

    def column(self, properties: Column) -> Column:
        v = get(properties, self.key)
        if self.op == "exists":
            return v.isNotNull()
        if self.op == "not_exists":
            return v.isNull()
        if self.op == "eq":
            return equal(v, self.value)
        if self.op == "ne":
            return v.isNotNull() & ~equal(v, self.value)
        if self.op == "contains":
            items = F.try_variant_get(v, "$", "array<variant>")
            member = (kind(v) == "array") & F.exists(items, lambda x: equal(x, self.value))
            found = member
            if isinstance(self.value, str):
                found = member | F.contains(F.lower(string(v)), F.lit(self.value.lower()))
            return F.coalesce(F.when(kind(v) == "array", member).otherwise(found), F.lit(False))
        numeric = isinstance(self.value, (int, float)) and not isinstance(self.value, bool)
        if not numeric and not isinstance(self.value, str):
            return F.lit(False)
        left = number(v) if numeric else string(v)
        right = F.lit(float(self.value)) if numeric else F.lit(self.value)
        made = {"gt": left > right, "lt": left < right, "gte": left >= right, "lte": left <= right}[self.op]
        return F.coalesce(made, F.lit(False))


def sort_keys(properties: Column, key: str) -> list[Column]:
    """Columns (rank, number, string) that order values: numbers, strings, other values."""
    v = get(properties, key)
    k = kind(v)
    rank = F.when(k == "number", 0).when(k == "string", 1).when(k.isNotNull(), 2)
    return [rank, number(v), string(v)]
