"""Note templates: placeholders are the schema."""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.errors import EngineError
from noteloom.functions.parsing import BUILTIN_VARS, PLACEHOLDER, template_vars

_SLOT = re.compile(PLACEHOLDER)


def templates(raw: DataFrame) -> DataFrame:
    """(name, vars, raw) of template texts (name, raw), by name."""
    return raw.select("name", template_vars("raw").alias("vars"), "raw").orderBy("name")


def check_name(name: str) -> str:
    """A bare name, or the error for one that would leave the folder."""
    if not name or any(x in name for x in ("/", "\\", "..")):
        raise EngineError("TEMPLATE_NOT_FOUND", f"{name!r} is no template name.", "list_templates gives the names.")
    return name


def scalar_text(value: Any) -> str:
    """A variable's value as text; anything but text, numbers and booleans is an error."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise EngineError("INVALID_INPUT", f"A template variable can't be {type(value).__name__}.", "Pass text, numbers or booleans.")


def render(raw: str, values: dict[str, Any], now: datetime | None = None) -> str:
    """The text with its placeholders filled; the caller's values go before the engine's own."""
    given = {k: scalar_text(v) for k, v in values.items()}
    wanted = dict.fromkeys(_SLOT.findall(raw))
    missing = [v for v in wanted if v not in given and v not in BUILTIN_VARS]
    if missing:
        raise EngineError("MISSING_VARS", f"The template needs: {', '.join(missing)}.", "Pass all of them in vars.")
    t = now or datetime.now().astimezone()
    own = {"date": t.strftime("%Y-%m-%d"), "time": t.strftime("%H:%M"), "datetime": t.isoformat()}
    return _SLOT.sub(lambda m: given.get(m[1], own.get(m[1], "")), raw)


def rendered(raw: Column, values: Column) -> Column:
    """Bulk form: texts filled from a map column; placeholders without a value stay."""
    fill = lambda text, e: F.regexp_replace(text, F.concat(F.lit(r"\{\{\s*"), e.key, F.lit(r"\s*\}\}")), F.regexp_replace(e.value, r"([\\$])", r"\\$1"))
    return F.aggregate(F.map_entries(values), raw, fill)
