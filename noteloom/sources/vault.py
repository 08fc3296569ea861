"""Reading a vault: a folder of Markdown notes, memories, templates and logs.

``<root>/**/*.md`` are notes, but for what lies in a folder of the engine's own name at any depth, which holds
``memory/*.md``, ``templates/*.md``, ``history`` and ``audit.log``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.parsing import body, frontmatter_block, parse_notes
from noteloom.functions.yamlio import parse_mapping
from noteloom.operators.deltas import scan_delta, unchanged_files
from noteloom.operators.memory import SCHEMA, valid
from noteloom.sources.places import Files, written

#: The engine's own folder in a vault.
OWN_DIR = ".noteloom"
#: Bytes of files that a task hands on at once, and rows of a listing.
_READ_BYTES, _LISTED = 8 << 20, 10_000
_LISTING = "path string, folder boolean, mtime_ms long, size long"


def _known(root: str) -> bool:
    """Whether executors can reach a place by Arrow's filesystems."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(_quoted(root))
    except (pa.ArrowInvalid, NotImplementedError):
        return False
    return True


def _quoted(root: str) -> str:
    scheme, colon, rest = root.partition(":")
    return f"{scheme}:{quote(rest if rest.startswith('//') else '//' + rest)}" if colon else f"file://{quote(root)}"


def listing(spark: SparkSession, root: str, own_dir: str = OWN_DIR, suffix: str = ".md") -> DataFrame:
    """(path, mtime_ms, size) of the files below ``root``, paths relative to it; folders named ``own_dir`` are left out.

    The executors list all folders of a depth at once, so there is a round for each level of the tree, and the driver sees
    whether a level has folders. Names that Spark's own listing hides, as they begin with '.' or '_', are names like others. A store that Arrow
    doesn't know is listed by the driver. A missing root has no files.
    """
    base = root.rstrip("/")
    if not _known(base):
        files = Files(spark, base)
        cut = len(files.fs().makeQualified(files.path()).toString()) + 1
        rows = ((s.getPath().toString()[cut:], s.getModificationTime(), s.getLen()) for s in files.walk_status(suffix, own_dir))
        return spark.createDataFrame(list(rows), "path string, mtime_ms long, size long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(_quoted(base))
        for pdf in frames:
            for folder in pdf["path"]:
                held = []
                for info in store.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True)):
                    held.append((f"{folder}/{info.base_name}".lstrip("/"), not info.is_file, (info.mtime_ns or 0) // 1_000_000, info.size or 0))
                    if len(held) == _LISTED:
                        yield pd.DataFrame(held, columns=["path", "folder", "mtime_ms", "size"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", "folder", "mtime_ms", "size"])

    todo, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        level = written(todo.mapInPandas(run, _LISTING), "listing")
        files = level.where(~F.col("folder") & F.endswith("path", F.lit(suffix))).select("path", "mtime_ms", "size")
        found = files if found is None else found.union(files)
        below = level.where(F.col("folder") & (F.substring_index("path", "/", -1) != own_dir)).select("path")
        if not below.limit(1).count():
            return found
        todo = below.repartition(spark.sparkContext.defaultParallelism, "path")


def read_files(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """``files`` (path, mtime_ms, size) with their content, read by the executors; files that have gone meanwhile are left out."""
    base = root.rstrip("/")
    if not _known(base):
        paths = [f"{base}/{r.path}" for r in files.select("path").collect()]
        got = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("__p"), "content") if paths else spark.createDataFrame([], "__p string, content binary")
        return files.join(got, F.endswith("__p", F.concat(F.lit("/"), "path"))).select("path", "mtime_ms", "size", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(_quoted(base))
        for batch in batches:
            keep, content, held = [], [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with store.open_input_stream(f"{top}/{path}") as f:
                        content.append(f.read())
                except FileNotFoundError:
                    continue
                keep.append(i)
                held += len(content[-1])
                if held >= _READ_BYTES:
                    yield _with_content(batch, keep, content)
                    keep, content, held = [], [], 0
            if keep:
                yield _with_content(batch, keep, content)

    return files.select("path", "mtime_ms", "size").repartition("path").mapInArrow(run, "path string, mtime_ms long, size long, content binary")


def _with_content(batch: pa.RecordBatch, keep: list[int], content: list[bytes]) -> pa.RecordBatch:
    rows = batch.take(pa.array(keep))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(content, pa.binary())], names=[*batch.schema.names, "content"])


def scan(spark: SparkSession, root: str, own_dir: str = OWN_DIR, lossy: bool = False) -> DataFrame:
    """(path, raw, mtime_ms, size) of all notes below ``root``, paths relative to it.

    Files that are not UTF-8 are skipped, or decoded with replacement characters if ``lossy``. A missing root has no notes.
    """
    return _decoded(read_files(spark, root, listing(spark, root, own_dir)), lossy)


def _decoded(files: DataFrame, lossy: bool) -> DataFrame:
    text = F.make_valid_utf8(F.col("content").cast("string")) if lossy else F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", text.alias("raw"), "mtime_ms", "size").where("raw IS NOT NULL")


def scan_changes(spark: SparkSession, root: str, shadow: DataFrame, own_dir: str = OWN_DIR, lossy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(delta, fresh): how a vault differs from a shadow (path, hash, mtime_ms, size), and the notes (path, raw, mtime_ms, size) that were read for it.

    Files whose time and size are the shadow's are taken as unchanged and not opened. ``delta`` (path, change) says 'created', 'modified' or
    'deleted' of the others by their contents; a file that was only touched is in ``fresh`` alone.
    """
    now = written(listing(spark, root, own_dir), "listing")
    same = unchanged_files(now.withColumnRenamed("path", "key"), shadow.withColumnRenamed("path", "key")).select(F.col("key").alias("path"))
    fresh = written(_decoded(read_files(spark, root, now.join(same, "path", "left_anti")), lossy), "fresh")
    there = fresh.select(F.col("path").alias("key"), F.sha2("raw", 256).alias("hash")).union(shadow.join(same, "path", "left_semi").select("path", "hash"))
    return scan_delta(there, shadow.select(F.col("path").alias("key"), "hash")).withColumnRenamed("key", "path"), fresh


def write_files(notes: DataFrame, root: str) -> int:
    """Write (path, raw) rows, text or binary, as files below ``root``, by the executors; a null raw removes the file. Returns how many.

    A file is written aside and renamed, so readers see the old one or the new one and a repeated task does no harm.
    """
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(_quoted(base))
        for batch in batches:
            # one content at a time, as a view of the batch
            for path, raw in zip(batch.column("path"), batch.column("raw"), strict=True):
                place = f"{top}/{path.as_py()}"
                if not raw.is_valid:
                    if store.get_file_info(place).is_file:
                        store.delete_file(place)
                    continue
                store.create_dir(place.rpartition("/")[0], recursive=True)
                aside = f"{place}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(aside) as f:
                    f.write(raw.as_buffer())
                store.move(aside, place)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return notes.select("path", "raw").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def notes(spark: SparkSession, root: str, own_dir: str = OWN_DIR) -> DataFrame:
    """Parsed notes of a vault."""
    return parse_notes(scan(spark, root, own_dir))


def memories(spark: SparkSession, root: str, own_dir: str = OWN_DIR) -> DataFrame:
    """Memories kept as Markdown files, in the order of their file names; broken ones are left out."""
    raw = scan(spark, f"{root.rstrip('/')}/{own_dir}/memory", own_dir="").where(~F.contains("path", F.lit("/")))
    typed = raw.select("path", F.from_json(parse_mapping(frontmatter_block("raw")), SCHEMA).alias("m"), F.regexp_replace(body("raw"), r"\n$", "").alias("content"))
    rows = typed.select("m.*", F.col("content").alias("__body"), "path").withColumn("content", F.col("__body"))
    return valid(rows.where("id IS NOT NULL")).orderBy("path").select(*SCHEMA.names)


def templates(spark: SparkSession, root: str, own_dir: str = OWN_DIR) -> DataFrame:
    """(name, raw) of the template files."""
    raw = scan(spark, f"{root.rstrip('/')}/{own_dir}/templates", own_dir="").where(~F.contains("path", F.lit("/")))
    return raw.select(F.regexp_replace("path", r"\.md$", "").alias("name"), "raw")


def audit_log(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The last entries of a JSON-lines audit file, newest first; malformed lines are left out.

    Later lines are newer, and those of a later file of a folder, by name, are newer than those of an earlier one. Places in a file come from
    where its part of it begins and the order within, so no task reads all.
    """
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("place")).where("value <> ''")
    parsed = lines.select("place", F.try_parse_json("value").alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    fields = [F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in ("ts", "action", "version_id", "change_id", "scope", "origin")]
    made = parsed.select("place", *fields, F.try_variant_get("v", "$.notes", "array<string>").alias("notes")).where("action IS NOT NULL AND version_id IS NOT NULL")
    return made.orderBy(F.desc("place")).limit(limit).drop("place")


def item_keys(notes_scan: DataFrame, memory_scan: DataFrame) -> DataFrame:
    """(key, hash, mtime_ms, size) of scans for change detection: n: for notes, m: for memories."""

    def one(df: DataFrame, prefix: str) -> DataFrame:
        name = F.regexp_replace("path", r"\.md$", "")
        return df.select(F.concat(F.lit(prefix), name).alias("key"), F.sha2(F.col("raw"), 256).alias("hash"), "mtime_ms", "size")

    return one(notes_scan, "n:").union(one(memory_scan, "m:"))
