"""An append-only sequenced log with snapshots: append, resume, compaction, chunked snapshots, outbox."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.errors import EngineError
from noteloom.operators.deltas import DEFAULT_QUOTA
from noteloom.sources.places import Files

ROWS = "seq long, ts long, blob binary"
PART_BYTES = 32 * 1024 * 1024


class SequencedLog:
    """Rows (seq, ts, blob) under a shared folder; one writer at a time hands out the numbers.

    A folder ``batch-<first>-<last>`` holds appended rows; it is written aside and renamed, which is the append's commit, so
    neither readers nor streams meet rows of a failed one. ``snapshot-<upto>`` is a compacted state.
    """

    def __init__(self, spark: SparkSession, root: str, quota: int = DEFAULT_QUOTA):
        self.spark, self.root, self.quota = spark, root.rstrip("/"), quota
        self.files = Files(spark, self.root)

    def _names(self) -> list[tuple[int, int, str]]:
        """(first, last, name) of the batches."""
        found = [n for n in self.files.names() if n.startswith("batch-")]
        return [(int(n.split("-")[1]), int(n.split("-")[2]), n) for n in found]

    def last_seq(self) -> int:
        return max([last for _, last, _ in self._names()] + [self.snapshot_seq()], default=0)

    def _batches(self, beyond: int = 0) -> DataFrame:
        names = [f"{self.root}/{n}" for _, last, n in self._names() if last > beyond]
        if not names:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*names).where(F.col("seq") > beyond)

    def used_bytes(self) -> int:
        return int(self._batches(self.snapshot_seq()).agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0])

    def append(self, blobs: DataFrame, order: str = "pos") -> int:
        """Append rows (order, ts, blob) and return the last number. A full log refuses.

        Numbers are dense in the order given; the rows are one producer's batch. Rows are dealt into ranges of the order, and
        numbered within a range from the ranges before it.
        """
        if self.used_bytes() >= self.quota:
            raise EngineError("IO_ERROR", "The log is over its quota.", "Compact it or raise the quota.")
        from pyspark.sql import Window

        start = self.last_seq()
        mark = uuid.uuid4().hex
        dealt = blobs.select(F.col(order).alias("o"), F.col("ts").cast("long").alias("ts"), "blob").repartitionByRange("o").withColumn("p", F.spark_partition_id())
        dealt.write.parquet(f"{self.root}/dealt-{mark}")
        rows = self.spark.read.parquet(f"{self.root}/dealt-{mark}")
        # a count for each range: as many as there are partitions
        counts = {r.p: r["count"] for r in rows.groupBy("p").count().collect()}
        before, total = {}, 0
        for p in sorted(counts):
            before[p] = total
            total += counts[p]
        if total:
            offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("p"))
            place = F.row_number().over(Window.partitionBy("p").orderBy("o"))
            rows.select((place + offset + start).cast("long").alias("seq"), "ts", "blob").write.parquet(f"{self.root}/written-{mark}")
            if not self.files.rename(f"written-{mark}", f"batch-{start + 1:020d}-{start + total:020d}"):
                raise EngineError("CONFLICT", "Another writer appended to the log.", "Append again.")
        self.files.delete(f"dealt-{mark}")
        return start + total

    def read_since(self, seq: int) -> DataFrame:
        """Rows after a number, in order."""
        return self._batches(seq).orderBy("seq")

    def snapshot_seq(self) -> int:
        found = [int(n.split("-")[1]) for n in self.files.names() if n.startswith("snapshot-") and self.files.exists(f"{n}/_SUCCESS")]
        return max(found, default=0)

    def compact(self, upto: int, parts: DataFrame) -> None:
        """Replace the rows up to a number by snapshot parts (idx, blob).

        The number must lie beyond the present snapshot and not beyond the log; a part may hold 32 MiB. The
        snapshot's success marker is the commit; then the covered rows go.
        """
        if not self.snapshot_seq() < upto <= self.last_seq():
            raise EngineError("INVALID_INPUT", f"A snapshot up to {upto} is stale or ahead of the log.", "Read the log's state again.")
        if parts.where(F.length("blob") > PART_BYTES).limit(1).count():
            raise EngineError("INVALID_INPUT", "A snapshot part is too large.", "Cut it into smaller parts.")
        parts.select(F.col("idx").cast("int"), "blob").write.mode("overwrite").parquet(f"{self.root}/snapshot-{upto:020d}")
        for name in self.files.names():
            if name.startswith("snapshot-") and int(name.split("-")[1]) < upto:
                self.files.delete(name)
        self._drop_covered(upto)

    def stage_part(self, upto: int, idx: int, blob: bytes) -> None:
        """Take one part of a snapshot that comes in chunks; parts come in order, part 0 starts anew."""
        if len(blob) > PART_BYTES:
            raise EngineError("INVALID_INPUT", "A snapshot part is too large.", "Cut it into smaller parts.")
        if idx == 0:
            self.files.delete(f"staged-{upto:020d}")
        have = len(self.files.names(f"staged-{upto:020d}"))
        if idx != have:
            raise EngineError("INVALID_INPUT", f"Part {idx} came where part {have} was due.", "Send the parts in order.")
        self.spark.createDataFrame([(idx, bytearray(blob))], "idx int, blob binary").coalesce(1).write.parquet(f"{self.root}/staged-{upto:020d}/part-{idx:08d}")

    def commit_staged(self, upto: int, of: int) -> None:
        """Compact with the staged parts if all of them are there; otherwise nothing changes."""
        names = self.files.names(f"staged-{upto:020d}")
        if len(names) != of or not of:
            raise EngineError("INVALID_INPUT", f"{len(names)} of {of} parts are there.", "Send the missing parts first.")
        self.compact(upto, self.spark.read.schema("idx int, blob binary").parquet(*[f"{self.root}/staged-{upto:020d}/{n}" for n in names]))
        self.files.delete(f"staged-{upto:020d}")

    def _drop_covered(self, upto: int) -> None:
        for _, last, name in self._names():
            if last <= upto:
                self.files.delete(name)

    def resume(self, seq: int) -> tuple[DataFrame | None, DataFrame]:
        """(snapshot parts or None, rows after): what a client at ``seq`` needs; a covered client starts anew."""
        upto = self.snapshot_seq()
        if upto > seq:
            parts = self.spark.read.schema("idx int, blob binary").parquet(f"{self.root}/snapshot-{upto:020d}").orderBy("idx")
            return parts, self.read_since(upto)
        return None, self.read_since(seq)


def fresh_rows(rows: DataFrame, cursor: int) -> DataFrame:
    """Rows beyond a cursor, each number once."""
    return rows.where(F.col("seq") > cursor).dropDuplicates(["seq"])


def compacted(snapshot: DataFrame, rows: DataFrame, upto: int) -> DataFrame:
    """Snapshot rows and the tail beyond ``upto``."""
    return snapshot.unionByName(rows.where(F.col("seq") > upto))


def complete_snapshots(parts: DataFrame) -> DataFrame:
    """(upto, of) of snapshot sets (upto, idx, of) whose parts are all there; a cursor moves to these only."""
    sets = parts.groupBy("upto", "of").agg(F.count_distinct("idx").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return sets.where("n = of AND lo = 0 AND hi = of - 1").select("upto", "of")


class Outbox:
    """An ordered at-least-once queue of rows (id, payload) in a shared folder.

    A row stays until it is acknowledged; queued twice under one id it is sent once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark, root), root.rstrip("/")

    def put(self, rows: DataFrame) -> None:
        n = len([x for x in self.files.names() if x.startswith("queued-")])
        rows.select(F.col("id").cast("string"), F.col("payload").cast("string")).withColumn("batch", F.lit(n)).withColumn(
            "place", F.monotonically_increasing_id()
        ).write.parquet(f"{self.root}/queued-{n:08d}")

    def ack(self, ids: DataFrame) -> None:
        n = len([x for x in self.files.names() if x.startswith("acked-")])
        ids.select(F.col("id").cast("string")).write.parquet(f"{self.root}/acked-{n:08d}")

    def pending(self) -> DataFrame:
        """Unacknowledged rows in the order they were put."""
        schema = "id string, payload string, batch int, place long"
        queued = [f"{self.root}/{n}" for n in self.files.names() if n.startswith("queued-")]
        acked = [f"{self.root}/{n}" for n in self.files.names() if n.startswith("acked-")]
        if not queued:
            return self.spark.createDataFrame([], "id string, payload string")
        rows = self.spark.read.schema(schema).parquet(*queued)
        if acked:
            rows = rows.join(self.spark.read.schema("id string").parquet(*acked), "id", "left_anti")
        first = rows.groupBy("id").agg(F.min(F.struct("batch", "place", "payload")).alias("x"))
        return first.orderBy("x.batch", "x.place").select("id", "x.payload")
