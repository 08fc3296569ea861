"""YAML in and out by the rules of YAML 1.2's core schema, through Arrow-batched functions.

YAML can't be parsed by built-in functions, so this is the one Python function on the parsing path; it sees
the frontmatter block only, not the note.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # without it, frontmatter written as JSON (which is YAML) still works
    yaml = None

if yaml is not None:

    class _Loader(yaml.SafeLoader):
        """Core schema: dates stay text, only true and false are booleans."""

    _Loader.yaml_implicit_resolvers = {}
    for _tag, _pattern, _first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+.0123456789"),
    ):
        _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))

    def _integer(loader: Any, node: Any) -> int:
        text = loader.construct_scalar(node)
        return int(text[2:], 8) if text.startswith("0o") else int(text, 16) if text.startswith("0x") else int(text, 10)

    def _float(loader: Any, node: Any) -> float:
        text = loader.construct_scalar(node).lower()
        return float(text.replace(".inf", "inf").replace(".nan", "nan"))

    _Loader.add_constructor("tag:yaml.org,2002:int", _integer)
    _Loader.add_constructor("tag:yaml.org,2002:float", _float)


def loads(text: str | None) -> Any:
    """The value of a YAML text; None if it is not valid."""
    if not text:
        return None
    if yaml is None:
        try:
            return json.loads(text)
        except ValueError:
            raise RuntimeError("PyYAML is needed to read frontmatter that isn't JSON") from None
    try:
        return yaml.load(text, Loader=_Loader)  # noqa: S506  a SafeLoader subclass
    except (yaml.YAMLError, ValueError, RecursionError):
        return None


def _plain(value: Any) -> Any:
    """JSON-ready: keys become text, what isn't finite becomes null."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else json.dumps(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def mapping_json(text: str | None) -> str:
    """A frontmatter block as a JSON object; anything else than a mapping gives an empty one."""
    value = loads(text)
    return json.dumps(_plain(value), ensure_ascii=False) if isinstance(value, dict) else "{}"


def dumps(properties: dict[str, Any]) -> str:
    """A mapping as YAML, in the order of its keys, ending in a newline."""
    if not properties:
        return ""
    if yaml is None:
        return json.dumps(properties, ensure_ascii=False) + "\n"
    return yaml.safe_dump(properties, sort_keys=False, allow_unicode=True, default_flow_style=False)


def dump_json(text: str | None) -> str:
    """A JSON object as YAML."""
    return dumps(json.loads(text)) if text else ""


def parse_mapping(block: Column) -> Column:
    """JSON text of a frontmatter block column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(mapping_json, na_action=None)

    return F.when(block.isNull() | (F.length(block) == 0), F.lit("{}")).otherwise(run(block))


def dump_mapping(properties_json: Column) -> Column:
    """YAML text of a column of JSON objects."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(dump_json, na_action=None)

    return run(properties_json)
