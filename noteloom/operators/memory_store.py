"""Memories in a shared folder, in layers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators import memory
from noteloom.sources.layers import LayeredTable


class MemoryStore:
    """Upserts by id and removals; readers see all of a change or nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.layers = LayeredTable(spark, root, "id", memory.SCHEMA)

    def table(self) -> DataFrame:
        return self.layers.read()

    def save(self, fresh: DataFrame) -> None:
        """Put memories in the place of those with their ids; of one id the last stays."""
        once = memory.upsert(self.spark.createDataFrame([], memory.SCHEMA), fresh)
        self.layers.overlay(once.select(*memory.SCHEMA.names, F.lit(False).alias("__gone")), action="save")
        self.layers.merge()

    def remember(self, args: dict[str, Any]) -> str:
        made = memory.memory_of(args)
        self.save(self.spark.createDataFrame([made], memory.SCHEMA))
        return made["id"]

    def forget(self, memory_id: str) -> bool:
        found = self.table().where(F.col("id") == memory_id)
        if found.isEmpty():
            return False
        self.layers.overlay(found.select(*memory.SCHEMA.names, F.lit(True).alias("__gone")), action="forget")
        self.layers.merge()
        return True
