"""The sequenced log as a streaming source whose offset is the row number.

A reader asks for the rows after its offset. Where a compaction has covered some of them it gets the parts of the snapshot
and then the rows beyond it, within the same query and checkpoint: lagging behind is no error. That holds for files that go while a
batch is being read, too: a part of the batch that finds its file gone reads the snapshot that took its place.

Rows are (seq, ts, idx, of, blob). A log row has no idx; part ``idx`` of ``of`` of a snapshot up to ``seq`` has no ts. A batch
that is repeated after a compaction may bring the snapshot where it brought rows before, and a snapshot may come again: what a
reader keeps by seq, or by snapshot, is the same either way (``sync.apply_batches``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

SCHEMA = "seq long, ts long, idx int, of int, blob binary"
_KINDS = pa.schema([("seq", pa.int64()), ("ts", pa.int64()), ("idx", pa.int32()), ("of", pa.int32()), ("blob", pa.binary())])
#: Rows that travel together.
ROWS = 1000


class _Part(ds.InputPartition):
    """A file of rows in (start, end], or a file of a snapshot up to ``upto``."""

    def __init__(self, path: str, start: int = 0, end: int = 0, upto: int | None = None, of: int = 0):
        self.path, self.start, self.end, self.upto, self.of = path, start, end, upto, of


class _Folder:
    """What lies in a log's folder, as Python processes without a session see it."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(root)

    def _files(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))

    def _folders(self, prefix: str) -> list[tuple[list[int], str]]:
        from pyarrow import fs

        names = [f.path for f in self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True)) if not f.is_file and f.path.rpartition("/")[2].startswith(prefix)]
        return sorted(([int(x) for x in n.rpartition("/")[2].split("-")[1:]], n) for n in names)

    def snapshot(self) -> tuple[int, list[str]]:
        """(upto, files) of the newest snapshot that is complete."""
        for (upto,), folder in reversed(self._folders("snapshot-")):
            if self.store.get_file_info(f"{folder}/_SUCCESS").is_file:
                return upto, self._files(folder)
        return 0, []

    def last(self) -> int:
        return max([self.snapshot()[0], *[last for (_, last), _ in self._folders("batch-")]])

    def rows(self, start: int, end: int) -> list[str]:
        return [f for (first, last), folder in self._folders("batch-") if last > start and first <= end for f in self._files(folder)]

    def parts_in(self, files: list[str]) -> int:
        import pyarrow.parquet as pq

        return sum(pq.read_metadata(self.store.open_input_file(f)).num_rows for f in files)


class LogReader(ds.DataSourceStreamReader):
    def __init__(self, root: str, cursor: int):
        self.root, self.cursor = root, cursor

    def initialOffset(self) -> dict:
        return {"seq": self.cursor}

    def latestOffset(self) -> dict:
        return {"seq": max(self.cursor, _Folder(self.root).last())}

    def partitions(self, start: dict, end: dict):
        folder, parts = _Folder(self.root), []
        after = start["seq"]
        upto, files = folder.snapshot()
        if upto > after:
            of = folder.parts_in(files)
            parts += [_Part(f, upto=upto, of=of) for f in files]
            after = upto
        return parts + [_Part(f, after, end["seq"]) for f in folder.rows(after, end["seq"])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        folder = _Folder(self.root)
        try:
            if partition.upto is None:
                yield from self._rows(folder, partition)
            else:
                yield from self._snapshot(folder, partition.path, partition.upto, partition.of)
        except FileNotFoundError:  # compacted meanwhile
            upto, files = folder.snapshot()
            if upto <= partition.start:
                raise
            of = folder.parts_in(files)
            for f in files:
                yield from self._snapshot(folder, f, upto, of)

    def _rows(self, folder: _Folder, partition: _Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for batch in pq.ParquetFile(folder.store.open_input_file(partition.path)).iter_batches(ROWS, columns=["seq", "ts", "blob"]):
            seq = batch.column("seq")
            batch = batch.filter(pc.and_(pc.greater(seq, partition.start), pc.less_equal(seq, partition.end)))
            none = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("ts"), none, none, batch.column("blob")], schema=_KINDS)

    def _snapshot(self, folder: _Folder, path: str, upto: int, of: int) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in pq.ParquetFile(folder.store.open_input_file(path)).iter_batches(1, columns=["idx", "blob"]):  # parts are large
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array([upto] * n), pa.nulls(n, pa.int64()), batch.column("idx").cast(pa.int32()), pa.array([of] * n, pa.int32()), batch.column("blob")], schema=_KINDS)


class LogSource(ds.DataSource):
    """``format("sequenced_log")``: options path, and cursor, the last number the reader has."""

    @classmethod
    def name(cls):
        return "sequenced_log"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return LogReader(self.options["path"].rstrip("/"), int(self.options.get("cursor", 0)))


def follow(spark: SparkSession, root: str, cursor: int = 0) -> DataFrame:
    """A stream of a log's rows after ``cursor``, by way of its snapshot where that covers some; the checkpoint keeps the place."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("sequenced_log").option("path", root).option("cursor", cursor).load()
