"""Changes from a log applied to a note store: queued first, debounced, guarded against local edits, versioned or in bulk.

    inbox/batch-<id>    changes (seq, note_id, raw) of a batch of the stream, written before the stream's place moves on
    shadow              (note_id, hash, seq) in layers: what each note was when it was last in step with the log, and up to which change

A batch is put in the inbox under its own id, so that it comes once however often it is repeated. Then the newest change of each note
is applied if the note is what the shadow says, or already what it is to become; a note that was edited here in the meantime keeps its
edit and the change waits in the inbox until ``in_step`` tells that the edit has been sent. Up to ``BULK`` notes make a version; more are
overlaid without history. The shadow is written last, by one record. After a stop between any two steps the next run finds
what was queued, sees what is applied already, and ends in the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteloom.errors import EngineError
from noteloom.operators.store import NoteStore
from noteloom.sources.layers import LayeredTable
from noteloom.sources.places import Files, written
from noteloom.streaming.sync import apply_batches, keeps_history

CHANGES = "seq long, note_id string, raw string"
#: A log row's blob, or a snapshot's part, as JSON: changes of notes, a null raw for a note that is gone.
BLOB = "array<struct<note_id: string, raw: string>>"


def digest(raw: Column) -> Column:
    """A note's hash; null for one that isn't there."""
    return F.sha2(raw, 256)


def changes_of(rows: DataFrame) -> DataFrame:
    """(seq, note_id, raw) of rows (seq, blob)."""
    found = rows.select("seq", F.explode(F.from_json(F.col("blob").cast("string"), BLOB)).alias("x"))
    return found.select("seq", "x.note_id", "x.raw").where("note_id IS NOT NULL")


class Applier:
    """The state of one store's application of a log, under a shared folder; one at a time."""

    def __init__(self, spark: SparkSession, root: str, store: NoteStore):
        self.spark, self.root, self.store = spark, root.rstrip("/"), store
        self.files = Files(spark, self.root)
        self.shadow = LayeredTable(spark, f"{self.root}/shadow", "note_id", "note_id string, hash string, seq long")

    # the steps, in their order
    def queue(self, rows: DataFrame, batch: int) -> None:
        """Put a batch in the inbox, in the place of what an earlier try of it left."""
        rows.write.mode("overwrite").parquet(f"{self.root}/inbox/batch-{batch:012d}")

    def pending(self) -> DataFrame:
        """(seq, note_id, raw): the newest change of each note that isn't applied yet."""
        names = self.files.names("inbox")
        if not names:
            return self.spark.createDataFrame([], CHANGES)
        queued = self.spark.read.schema(CHANGES).parquet(*[f"{self.root}/inbox/{n}" for n in names])
        newest = queued.groupBy("note_id").agg(F.max_by("raw", "seq").alias("raw"), F.max("seq").alias("seq"))
        done = self.shadow.read().select("note_id", F.col("seq").alias("done"))
        return newest.join(done, "note_id", "left").where("done IS NULL OR seq > done").select("seq", "note_id", "raw")

    def flush(self) -> dict[str, int]:
        """Apply what may be applied: {applied, waiting}. Nothing is taken from the inbox before the shadow knows of it."""
        names = self.files.names("inbox")
        asked = self.pending()
        now = self.store.raw().select("note_id", F.col("raw").alias("held"))
        was = self.shadow.read().select("note_id", F.col("hash").alias("was"))
        state = asked.join(now, "note_id", "left").join(was, "note_id", "left")
        same = digest(F.col("held")).eqNullSafe(digest(F.col("raw")))
        safe = same | digest(F.col("held")).eqNullSafe(F.col("was"))
        judged = written(state.select("seq", "note_id", "raw", same.alias("same"), safe.alias("safe")), "judged")
        counts = judged.agg(F.count_if(F.col("safe")).alias("safe"), F.count_if(F.col("safe") & ~F.col("same")).alias("change"), F.count_if(~F.col("safe")).alias("waiting")).first()
        if counts.change:
            self._write(judged.where("safe AND NOT same"), counts.change)
        if counts.safe:
            self._remember(judged.where("safe"))
        if not counts.waiting:
            for name in names:  # all that they hold is in the shadow
                self.files.delete(f"inbox/{name}")
        return {"applied": counts.change, "waiting": counts.waiting}

    def _write(self, changes: DataFrame, n: int) -> None:
        if keeps_history(n):
            none = F.lit(None).cast("string")
            self.store.apply_many(changes.select("seq", F.lit("setraw").alias("op"), "note_id", none.alias("content"), none.alias("frontmatter"), "raw"))
        else:
            self.store.overlay_many(changes)

    def _remember(self, rows: DataFrame) -> None:
        self.shadow.overlay(rows.select("note_id", digest(F.col("raw")).alias("hash"), "seq", F.lit(False).alias("__gone")), action="applied")
        self.shadow.merge()

    # the other direction, and the stream
    def in_step(self, notes: DataFrame) -> None:
        """Notes (note_id, raw, seq) that are in step with the log: loaded from it, or edited here and sent as change ``seq``."""
        self._remember(notes)

    def take(self, rows: DataFrame, batch: int) -> None:
        """One batch of a stream (seq, blob): queued for certain, applied unless another writer came first."""
        self.queue(changes_of(rows), batch)
        try:
            self.flush()
        except EngineError as e:
            if e.code != "CONFLICT":
                raise  # a conflict is left to the next batch: the change is in the inbox

    def run(self, stream: DataFrame, checkpoint: str, every: str = "250 milliseconds", once: bool = False) -> StreamingQuery:
        """Apply a stream of a log's rows; what comes within an interval is applied together, once for each note."""
        return apply_batches(stream, self.take, checkpoint, every, once)
