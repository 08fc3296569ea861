"""Streams over logs: resume from a cursor, debounced application, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteloom.sources.log import ROWS, SequencedLog

#: Changed notes in a batch above which versions aren't kept one by one.
BULK = 200


def tail(spark: SparkSession, root: str, cursor: int = 0) -> DataFrame:
    """A stream of log rows beyond a cursor; the checkpoint keeps the place. Rows of failed appends are never in it."""
    rows = spark.readStream.schema(ROWS).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{root.rstrip('/')}/batch-*")
    return rows.where(F.col("seq") > cursor)


def resume_tail(log: SequencedLog, cursor: int) -> tuple[DataFrame | None, DataFrame]:
    """(snapshot parts or None, stream): a reader whose rows were compacted away starts from the snapshot.

    This stream of files ends with an error if a compaction overtakes it; ``logsource.follow`` goes on from the snapshot.
    """
    parts, _ = log.resume(cursor)
    return parts, tail(log.spark, log.root, max(cursor, log.snapshot_seq()))


def apply_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "250 milliseconds", once: bool = False) -> StreamingQuery:
    """Apply batches of changes: one batch gathers what came in the interval, each seq once.

    ``apply`` gets (rows, batch id) and must be idempotent by the id: a batch that failed comes again under
    the same one, before any later batch.
    """
    keys = ["seq", "idx"] if "idx" in stream.columns else ["seq"]
    run = lambda rows, batch: apply(rows.dropDuplicates(keys).orderBy(*keys), batch)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def safe_to_apply(changes: DataFrame, current: DataFrame, shadow: DataFrame) -> DataFrame:
    """Changes (key, raw) whose target is what it was at the last sync; locally changed items are left for later."""
    now = current.select("key", F.col("hash").alias("__now"))
    was = shadow.select("key", F.col("hash").alias("__was"))
    both = changes.join(now, "key", "left").join(was, "key", "left")
    return both.where(F.col("__now").eqNullSafe(F.col("__was"))).drop("__now", "__was")


def keeps_history(changed: int) -> bool:
    """Whether a batch of changes is small enough to be versioned note by note."""
    return changed <= BULK


def windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event-time counts and sums of a stream (ts, event_type, value); an extension beyond logs."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "45 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream (ts, user_id): the stream form of presence with a time to live."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")
