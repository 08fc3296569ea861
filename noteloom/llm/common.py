"""Helpers shared by the training-data operators: staging, table access, Arrow text access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FALLBACK: dict[str, str] = {}
_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is empty and Spark runs in this process (tests) a temporary folder is chosen and set; on a
    cluster a missing setting is an error, as executors don't share this machine's folders.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _FALLBACK:
            _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="noteloom-")
        place = _FALLBACK[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(filesystem, path) of Hadoop for a URL, so any store that Spark reaches can be used."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file as a whole, or not at all if there is one of this name already.

    It is written aside and renamed without overwriting, which is one step where the store has it so, as HDFS does.
    """
    fs, aside = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    _, place = hadoop_path(spark, path)
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, place, options)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = hadoop_path(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def new_dir(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path under the shared folder, removed when the driver ends, or by ``release`` unless ``keep``."""
    path = f"{shared_dir(spark)}/noteloom/{label}-{uuid.uuid4().hex}"
    atexit.register(_quietly_remove, spark, path)
    if not keep:
        _SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove what operators have staged so far; their results must have been written elsewhere by then."""
    while _SCRATCH:
        remove(spark, _SCRATCH.pop())


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone already at interpreter exit
        pass


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at a place that outlives any executor, and the written columns can be
    pruned by later readers, which a checkpointed RDD cannot.
    """
    spark = df.sparkSession
    path = new_dir(spark, label, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Staged partitions whose kept rows share one side file.
_SIDE_BITS = 4


def rows_kept(table: DataFrame, uids: DataFrame, columns: list[Column], then: Callable | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a staged ``table`` whose __uid (monotonically_increasing_id) is in ``uids`` (__uid), without a shuffle of the table.

    The ids are written in the shared folder by the partition that their upper bits name; a task reads the
    side files of its own rows only. ``then`` maps record batches of the kept rows (columns, without __uid) to batches
    of ``schema``.
    """
    side = new_dir(table.sparkSession, "side")
    group = F.shiftright("__uid", 33 + _SIDE_BITS).alias("g")
    uids.select("__uid", group).repartition("g").sortWithinPartitions("g", "__uid").write.partitionBy("g").parquet(side)
    rows = table.select("__uid", *columns)
    out = T.StructType(rows.schema.fields[1:]) if schema is None else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(side)
        known: dict[int, np.ndarray] = {}

        def ids_of(g: int) -> np.ndarray:
            if g not in known:
                known.clear()
                files = store.get_file_info(fs.FileSelector(f"{base}/g={g}", allow_not_found=True))
                parts = [pq.read_table(store.open_input_file(f.path), columns=["__uid"]).column(0).to_numpy() for f in files if f.path.endswith(".parquet")]
                known[g] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            return known[g]

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                uid = batch.column(0).to_numpy()
                keep = np.zeros(len(uid), bool)
                for g in np.unique(uid >> (33 + _SIDE_BITS)):
                    mine = uid >> (33 + _SIDE_BITS) == g
                    keep[mine] = np.isin(uid[mine], ids_of(int(g)))
                if keep.any():
                    yield batch.filter(pa.array(keep)).select(range(1, batch.num_columns))

        yield from then(kept()) if then else kept()

    return rows.mapInArrow(run, out)


#: Ids that are broadcast at most, of 8 bytes each.
SMALL = 2_000_000


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    """A table of ids marked for broadcast if it has at most ``SMALL`` rows, counted; as it is otherwise."""
    return F.broadcast(ids) if ids.limit(SMALL + 1).count() <= SMALL else ids


def placed(df: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``df`` with __pos, a row's place from 0 in its group by ``order`` (nulls first), and __n, the rows of the group.

    No group meets in one task: rows are dealt by ranges of (group, order) and written; a group's places go on from range to
    range by the counts of the ranges before, of which a group has one a partition at most. ``group`` isn't null.
    """
    from pyspark.sql import Window

    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = staged(dealt.withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", 33).alias("__part")
    runs = rows.groupBy(group, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")
    runs = runs.select(group, "__part", start.alias("__start"), F.sum("__rows").over(Window.partitionBy(group)).alias("__n"))
    found = rows.select("*", part).join(runs, [group, "__part"])
    return found.select(*df.columns, (F.col("__at") + F.col("__start")).alias("__pos"), "__n")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` with the shared folder set; Spark removes it when it is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts. No copy is made."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    n, kind = len(col), np.int64 if wide else np.int32
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def row_slices(offs: np.ndarray, max_bytes: int = 1 << 20):
    """Row ranges of about ``max_bytes`` of text each, one row at least."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi
