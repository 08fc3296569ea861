"""Tables that change in layers: a base, and small overlays of changed rows, named by a log of records.

    data/<name>         a layer, as Parquet; a layer may also be a column of rows that lie elsewhere under the root, see ``adopt``
    log/<n>.json        the n-th record: the layers that make up the table after the n-th change, and what the change was

A record is created as a whole under a name that wasn't there, after its layers are written, and is the change's only commit:
a reader sees all of a change or nothing, a stop before it leaves nothing that is read, and of two writers at once one
gets a conflict. A change that was checked against a state names that state's number and is committed as the very next one or not at all.
The log is the audit, too, so a change and its entry can't part. ``merge`` makes a new base, in a record of its own.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.errors import EngineError
from noteloom.sources.places import Files

#: Layers of a table before they are merged.
LAYERS = 8
_GONE = "__gone"


class Records:
    """The numbered records of a folder, each created once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("log")]

    def _record(self, number: int) -> dict[str, Any]:
        return json.loads(self.files.read(f"log/{number:012d}.json") or "{}")

    def newest(self) -> dict[str, Any]:
        """The newest record with its number; number 0 and no layers where nothing was written yet."""
        n = max(self.numbers(), default=0)
        return {"number": n} | (self._record(n) if n else {"layers": []})

    def _commit(self, number: int, layers: list[str], what: dict[str, Any]) -> None:
        if not self.files.create(f"log/{number:012d}.json", json.dumps({"layers": layers} | what)):
            raise EngineError("CONFLICT", "Another writer changed the store.", "Read it again and repeat the change.")

    def vacuum(self, keep: int = 2) -> None:
        """Remove layers that none of the last ``keep`` records names; the writer's call, as others' unnamed layers go too."""
        used = {name for n in sorted(self.numbers())[-keep:] for name in self._record(n)["layers"]}
        for name in self.files.names("data"):
            if name not in used:
                self.files.delete(f"data/{name}")


class LayeredTable(Records):
    """Rows with a key, changed by overlays of rows; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str | T.StructType):
        super().__init__(spark, root)
        self.key = key
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def read(self, at: dict[str, Any] | None = None, values: dict[str, Column] | None = None) -> DataFrame:
        """The table after the newest change, or after that of a record from ``newest``.

        ``values``: the key and these columns instead of all. They are made in each layer, before layers are joined, so
        what they don't hold is never shuffled.
        """
        return self._rows((at or self.newest())["layers"], values)

    @staticmethod
    def _place(name: str) -> str:
        return name.split(":")[0] if ":" in name else f"data/{name}"

    def _layer(self, name: str) -> DataFrame:
        """The rows of a layer after the base, with the mark of removed ones."""
        if ":" not in name:
            return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(_GONE, T.BooleanType())])).parquet(f"{self.root}/data/{name}")
        place, column = name.split(":")
        (value,) = [f for f in self.schema.fields if f.name != self.key]
        rows = self.spark.read.schema(T.StructType([self.schema[self.key], T.StructField(column, value.dataType)])).parquet(f"{self.root}/{place}")
        return rows.select(self.key, F.col(column).alias(value.name), F.col(column).isNull().alias(_GONE))

    def _rows(self, layers: list[str], values: dict[str, Column] | None = None) -> DataFrame:
        names = [self.key, *values] if values is not None else self.schema.names
        cols = [F.col(self.key), *[v.alias(n) for n, v in values.items()]] if values is not None else [F.col(c) for c in names]
        if not layers:
            return self.spark.createDataFrame([], self.schema).select(*cols)
        base = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{layers[0]}").select(*cols)
        if len(layers) == 1:
            return base
        over = [self._layer(name).select(*cols, _GONE) for name in layers[1:]]
        last = over[0]  # a key comes once in a layer
        if len(over) > 1:
            row = F.struct(*[c for c in names if c != self.key], _GONE).alias("row")
            every = None
            for i, one in enumerate(over):
                part = one.select(self.key, F.lit(i).alias("i"), row)
                every = part if every is None else every.union(part)
            last = every.groupBy(self.key).agg(F.max_by("row", "i").alias("row")).select(self.key, "row.*")
        kept = base.join(last.select(self.key), self.key, "left_anti").select(*names)
        return kept.union(last.where(~F.col(_GONE)).select(*names))

    def _write(self, rows: DataFrame) -> str:
        name = f"layer-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}")
        return name

    def replace(self, rows: DataFrame, **what: Any) -> None:
        """A new base with these rows only."""
        now = self.newest()
        self._commit(now["number"] + 1, [self._write(rows.select(*self.schema.names))], what)

    def overlay(self, rows: DataFrame, at: dict[str, Any] | None = None, **what: Any) -> None:
        """Put rows in the place of those with their keys; rows marked ``__gone`` are removed. A key comes once.

        ``at``: the record that the change was checked against; if another change came after it, this one is a conflict.
        """
        now = at or self.newest()
        layers = now["layers"] or [self._write(self.spark.createDataFrame([], self.schema))]
        self._commit(now["number"] + 1, [*layers, self._write(rows.select(*self.schema.names, F.coalesce(_GONE, F.lit(False)).alias(_GONE)))], what)

    def adopt(self, place: str, column: str, at: dict[str, Any] | None = None, **what: Any) -> None:
        """``overlay`` by rows that a folder ``place`` under the root has already, so they aren't written twice.

        For tables of a key and one value: ``column`` is the value, null where the key is removed. The folder must stay.
        """
        now = at or self.newest()
        layers = now["layers"] or [self._write(self.spark.createDataFrame([], self.schema))]
        self._commit(now["number"] + 1, [*layers, f"{place}:{column}"], what)

    def merge(self) -> bool:
        """Write a new base if there are more layers than ``LAYERS``; False if there are not, or if another writer came first."""
        now = self.newest()
        if len(now["layers"]) <= LAYERS:
            return False
        base = self._write(self._rows(now["layers"]))
        try:
            self._commit(now["number"] + 1, [base], {"merged": len(now["layers"])})
        except EngineError:
            return False
        return True

    def log(self, fields: str) -> DataFrame:
        """(n, fields of the records), malformed records with nulls."""
        if not self.numbers():
            return self.spark.createDataFrame([], f"n int, {fields}")
        lines = self.spark.read.option("wholetext", True).text(f"{self.root}/log/*.json").select("value", F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int").alias("n"))
        return lines.select("n", F.from_json("value", fields).alias("e")).select("n", "e.*")

    def changed_since(self, number: int) -> DataFrame | None:
        """The keys changed after a record, each once; None where layers of their own don't tell them."""
        names = []
        for n in range(number + 1, self.newest()["number"] + 1):
            record, before = self._record(n), self._record(n - 1)["layers"] if n > 1 else []
            if "merged" in record:
                continue
            if not before or record["layers"][:-1] != before or not self.files.exists(place := self._place(record["layers"][-1])):
                return None
            names.append(place)
        if not names:
            return self.spark.createDataFrame([], f"{self.key} string")
        return self.spark.read.schema(f"{self.key} string").parquet(*[f"{self.root}/{name}" for name in names]).distinct()
