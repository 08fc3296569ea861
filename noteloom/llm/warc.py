"""WARC archives: a writer that stores equal payloads once, and a Spark data source that reads archives back.

``write_archives`` writes a gzip member for every record. Of the pages with equal payloads of ``MIN_REVISIT`` bytes or more the one
with the largest id is a response, the others are revisits that name it. Which rows are revisits is found on digests alone; the
rows' marks are written by the partition they belong to, so payloads are never shuffled. A file is written under a name
of its task's attempt and renamed, so a repeated task replaces it by an equal one.

``read_archives`` is a Python data source. It plans ranges of files; a range begins at its first record. Headers are parsed first,
filters on them decide, and what they reject is skipped: without inflating it where the member tells its length, as
ours do. Without the payload column no payload is inflated at all.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from noteloom.llm.common import new_dir, staged

#: Bytes of a payload from which equal ones become revisits.
MIN_REVISIT = 1000
#: Bytes of a finished file, and of a range that one task reads.
FILE_BYTES, SPLIT_BYTES = 1 << 30, 64 << 20
#: A file's records have no time of their own unless the caller gives one; the same rows then make the same bytes.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6

# Fixed values of the WARC 1.1 and gzip formats.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_START, HAS_EXTRA, LENGTH_FIELD = b"\x1f\x8b\x08", 4, b"SL"

_HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "date": "warc-date",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
_COLUMNS = dict.fromkeys([*_HEADERS, "payload_sha1"], pa.string()) | {"content_length": pa.int64(), "payload_length": pa.int64(), "path": pa.string(), "offset": pa.int64()}
SCHEMA = ", ".join(f"{c} {'string' if kind == pa.string() else 'long'}" for c, kind in _COLUMNS.items())
_SIDE_BITS = 4


# --- writing ---


def _member(data: bytes, token: bytes) -> bytes:
    """A gzip member whose extra field tells its length and carries the file's token."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 4 + 16 + len(body) + 8
    extra = LENGTH_FIELD + struct.pack("<HQ", 16, total) + token
    return GZIP_START + bytes([HAS_EXTRA]) + b"\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(text: str | None) -> str:
    """A header's value on one line: blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: quote(m[0]), text or "about:blank")


def record_id(page: Any, uid: int) -> str:
    return f"<urn:page:{'' if page is None else quote(str(page), safe='')}:{uid}>"


def write_archives(pages: DataFrame, out_dir: str, date: str = DATE, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write (page_id, url, html) as ``.warc.gz`` files under ``out_dir`` (a URL that executors reach) and list them: (path, n_records, n_bytes).

    Written when this returns. A null html is an empty payload; a null url becomes ``about:blank``; a null page_id counts as the
    smallest. Repeated rows are records of their own; of rows with the largest id one is the response. Texts of any length
    are written whole. Other columns aren't read. An empty table gives no file.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("string").alias("page"), F.col("page_id").alias("rank"), "url", F.coalesce("html", F.lit("")).alias("html"))
    kept = staged(rows.select("*", F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("n"), F.monotonically_increasing_id().alias("uid")), "warc-pages")
    slim = kept.where(F.col("n") >= min_revisit).select("sha1", "rank", "page", "uid")
    owners = slim.groupBy("sha1").agg(F.max(F.struct("rank", "uid", "page")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = slim.join(owners, "sha1").where("uid <> first.uid").select("uid", F.col("first.page").alias("of_page"), F.col("first.uid").alias("of_uid"))
    side = new_dir(spark, "warc-marks")
    group = F.shiftright("uid", 33 + _SIDE_BITS)
    again.withColumn("g", group).repartition("g").sortWithinPartitions("g", "uid").write.partitionBy("g").parquet(side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out_dir)
        marks = _Marks(side)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        sink = name = None
        count = size = number = 0
        token = b""

        def put(data: bytes) -> None:
            nonlocal size
            member = _member(data, token)
            sink.write(member)
            size += len(member)

        def close() -> tuple[str, int, int]:
            sink.close()
            store.move(f"{name}.{attempt}.part", name)
            return name.rpartition("/")[2], count, size

        done = []
        for batch in batches:
            for page, url, html, sha1, uid in zip(*(batch.column(c).to_pylist() for c in ("page", "url")), batch.column("html").cast(pa.binary()), *(batch.column(c).to_pylist() for c in ("sha1", "uid")), strict=True):
                if sink is None:
                    store.create_dir(base, recursive=True)
                    name, count, size = f"{base}/pages-{part:06d}-{number:04d}.warc.gz", 0, 0
                    token = struct.pack("<II", zlib.crc32(f"{part}/{number}".encode()), part)
                    sink, number = store.open_output_stream(f"{name}.{attempt}.part"), number + 1
                    put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{part}:{number - 1}>"), ("WARC-Date", date), ("WARC-Filename", name.rpartition("/")[2]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                payload = html.as_buffer().to_pybytes()
                mark = marks.find(uid)
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                head = [
                    ("WARC-Type", "revisit" if mark else "response"), ("WARC-Record-ID", record_id(page, uid)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("Content-Type", "application/http;msgtype=response"),
                    ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"), ("X-Payload-Length", str(len(payload))),
                ]
                if mark:
                    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*mark))]
                put(_record(head, http if mark else http + payload))
                count += 1
                if size >= FILE_BYTES:
                    done.append(close())
                    sink = None
        if sink is not None:
            done.append(close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    return staged(kept.select("page", "url", "html", "sha1", "uid").mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-files")


class _Marks:
    """The revisits among the rows of a task, from the side files of its partition."""

    def __init__(self, side: str):
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(side)
        self.group, self.uid, self.rows = -1, np.zeros(0, np.int64), None

    def find(self, uid: int) -> tuple[str | None, int] | None:
        if uid >> (33 + _SIDE_BITS) != self.group:
            self._load(uid >> (33 + _SIDE_BITS))
        at = int(np.searchsorted(self.uid, uid))
        if at == len(self.uid) or self.uid[at] != uid:
            return None
        return self.rows.column("of_page")[at].as_py(), self.rows.column("of_uid")[at].as_py()

    def _load(self, group: int) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files = self.store.get_file_info(fs.FileSelector(f"{self.base}/g={group}", allow_not_found=True))
        parts = [pq.read_table(self.store.open_input_file(f.path), columns=["uid", "of_page", "of_uid"]) for f in files if f.path.endswith(".parquet")]
        self.group, self.rows = group, pa.concat_tables(parts).sort_by("uid") if parts else None
        self.uid = self.rows.column("uid").to_numpy() if parts else np.zeros(0, np.int64)


# --- reading ---


class _Window:
    """Bytes of a file by place, read a megabyte or more at a time."""

    def __init__(self, store, path: str):
        self.file, self.start, self.data = store.open_input_file(path), 0, b""
        self.size = self.file.size()

    def get(self, at: int, n: int) -> bytes:
        if not self.start <= at or at + n > self.start + len(self.data):
            self.start, self.data = at, self.file.read_at(max(0, min(max(n, 1 << 20), self.size - at)), at)
        return self.data[at - self.start : at - self.start + n]


def _length_of(window: _Window, at: int) -> tuple[int, bytes]:
    """(length, token) of the member at a place, (0, b'') if it doesn't tell."""
    head = window.get(at, 12)
    if len(head) < 12 or head[:3] != GZIP_START or not head[3] & HAS_EXTRA:
        return 0, b""
    extra = window.get(at + 12, struct.unpack("<H", head[10:12])[0])
    while len(extra) >= 4:
        n = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == LENGTH_FIELD and n == 16 and len(extra) >= 20:
            return struct.unpack("<Q", extra[4:12])[0], extra[12:20]
        extra = extra[4 + n :]
    return 0, b""


def _first_record(window: _Window, start: int, end: int) -> int | None:
    """The place of the first record that begins in a range. Only files with tokens can be entered in their middle."""
    if start == 0:
        return 0
    length, token = _length_of(window, 0)
    if not length:
        return None
    at = start
    while at < min(end, window.size):
        chunk = window.get(at, min(1 << 20, window.size - at))
        found = chunk.find(GZIP_START)
        if found < 0:
            at += max(1, len(chunk) - 2)
        elif at + found >= end:
            return None
        elif _length_of(window, at + found)[1] == token:
            return at + found
        else:
            at += found + 1
    return None


class _Inflated:
    """What a gzip member holds, inflated as far as it is asked for; ``end`` is where the next member begins."""

    def __init__(self, window: _Window, at: int):
        self.window, self.at, self.data = window, at, bytearray()
        self.length = _length_of(window, at)[0]
        self.fed, self.z = at, zlib.decompressobj(zlib.MAX_WBITS | 16)

    def more(self, step: int, most: int = 0) -> bool:
        """Inflate what the next bytes hold, up to ``most`` bytes of it if that isn't 0."""
        if self.z.eof:
            return False
        raw = self.z.unconsumed_tail
        if not raw:
            raw = self.window.get(self.fed, step)
            self.fed += len(raw)
        made = self.z.decompress(raw, most)
        if not raw and not made:
            raise ValueError(f"the member at {self.at} has no end")
        self.data += made
        return True

    def until(self, mark: bytes, start: int = 0) -> int:
        """The place of a mark; -1 if there is none."""
        while (found := self.data.find(mark, start)) < 0:
            if not self.more(1024, 512):
                return -1
        return found

    def whole(self) -> bytearray:
        while self.more(1 << 16):
            pass
        return self.data

    def end(self) -> int:
        if self.length:
            return self.at + self.length
        while self.more(1 << 16):  # foreign members: to be inflated to their ends, nothing is kept
            self.data = bytearray()
        return self.fed - len(self.z.unused_data)


class _Plain:
    """The same for a record of an uncompressed file."""

    def __init__(self, window: _Window, at: int):
        self.window, self.at, self.data, self.size = window, at, bytearray(), None

    def until(self, mark: bytes, start: int = 0) -> int:
        while (found := self.data.find(mark, start)) < 0:
            raw = self.window.get(self.at + len(self.data), min(1024, self.window.size - self.at - len(self.data)))
            if not raw:
                return -1
            self.data += raw
        return found

    def sized(self, n: int) -> None:
        self.size = n

    def whole(self) -> bytes:
        return self.window.get(self.at, min(self.size, self.window.size - self.at))

    def end(self) -> int:
        at = self.at + self.size
        while self.window.get(at, 2) == b"\r\n":
            at += 2
        return at


def _headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name, continued lines joined; the first of equal names counts."""
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def _sha1(value: str | None) -> str | None:
    """A digest's hexadecimal form, from base 32 or 16."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()
    except ValueError:
        return None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isdigit() else None


def records(store, path: str, start: int, end: int, wanted: Callable[[dict], bool], payloads: bool) -> Iterator[dict]:
    """Records that begin in a range of a file and whose headers are wanted."""
    window = _Window(store, path)
    packed = window.get(0, 3) == GZIP_START
    at = _first_record(window, start, end) if packed else (0 if start == 0 else None)
    if not packed:
        end = window.size  # without members there is no safe place to begin in the middle
    elif at == 0 and not _length_of(window, 0)[0]:
        end = window.size
    while at is not None and at < min(end, window.size):
        record = (_Inflated if packed else _Plain)(window, at)
        cut = record.until(b"\r\n\r\n")
        if cut < 0 or not record.data.startswith(b"WARC/"):
            raise ValueError(f"{path}: no WARC record at {at}")
        h = _headers(bytes(record.data[:cut]))
        n = _number(h.get("content-length")) or 0
        if not packed:
            record.sized(cut + 4 + n)
        row = {c: h.get(k) for c, k in _HEADERS.items()} | {"payload_sha1": _sha1(h.get("warc-payload-digest")), "content_length": n, "payload_length": _number(h.get("x-payload-length")), "path": path.rpartition("/")[2], "offset": at}
        if wanted(row):
            if payloads:
                row["payload"] = _payload(record, row, cut + 4, n)
            yield row
        at = record.end()


def _payload(record, row: dict, at: int, n: int) -> bytes | None:
    """What follows the HTTP header in a block of HTTP, else the block; a revisit has none."""
    if row["record_type"] == "revisit":
        return None
    data = record.whole()[at : at + n]
    if (row["content_type"] or "").startswith("application/http"):
        cut = data.find(b"\r\n\r\n")
        data = data[cut + 4 :] if cut >= 0 else b""
    return bytes(data)


class _Range(ds.InputPartition):
    def __init__(self, path: str | None, start: int = 0, end: int = 0):
        self.path, self.start, self.end = path, start, end


def _test(f: ds.Filter) -> Callable[[dict], bool] | None:
    """A filter on a header column as a function of a record's headers, None for what can't be decided on them."""
    if isinstance(f, ds.Not):
        inner = f.child
        if isinstance(inner, (ds.EqualTo, ds.In, ds.StringStartsWith, ds.StringContains, ds.StringEndsWith)) and (test := _test(inner)):
            c = inner.attribute[0]
            return lambda row: row[c] is not None and not test(row)
        return None
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in _COLUMNS:
        return None
    c, v = f.attribute[0], getattr(f, "value", None)
    if isinstance(f, ds.IsNotNull):
        return lambda row: row[c] is not None
    if isinstance(f, ds.IsNull):
        return lambda row: row[c] is None
    if isinstance(f, ds.EqualNullSafe):
        return lambda row: row[c] == v
    if isinstance(f, ds.In):
        if None in f.value:
            return None
        among = set(f.value)
        return lambda row: row[c] in among
    if v is None:
        return None
    tests = {
        ds.EqualTo: lambda x: x == v, ds.GreaterThan: lambda x: x > v, ds.GreaterThanOrEqual: lambda x: x >= v, ds.LessThan: lambda x: x < v, ds.LessThanOrEqual: lambda x: x <= v,
        ds.StringStartsWith: lambda x: x.startswith(v), ds.StringEndsWith: lambda x: x.endswith(v), ds.StringContains: lambda x: v in x,
    }
    test = tests.get(type(f))
    if test is None or isinstance(v, str) and not v.isascii():  # other orders of text than by code points aren't guessed at
        return None
    return lambda row: row[c] is not None and test(row[c])


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(base)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        files = [f for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz"))]
        cuts = [_Range(f.path, at, min(at + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.split)]
        return cuts or [_Range(None)]

    def read(self, partition):
        from pyarrow import fs

        if partition.path is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        tests = [_test(f) for f in self.filters]
        kinds = pa.schema([*_COLUMNS.items(), *([("payload", pa.binary())] if self.payloads else [])])
        held, size = [], 0
        for row in records(store, partition.path, partition.start, partition.end, lambda r: all(t(r) for t in tests), self.payloads):
            held.append(row)
            size += 500 + len(row.get("payload") or b"")
            if size >= 8 << 20:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)


class WarcSource(ds.DataSource):
    """``format("warc")``: options path (file or folder), payload (true), splitBytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA + (", payload binary" if self.options.get("payload", "true").lower() == "true" else "")

    def reader(self, schema):
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the WARC files at a path (``.warc``, ``.warc.gz``, folders of them), with header columns and, if wanted, payloads.

    Filters on header columns are decided before a payload is inflated. A header that is missing is null; a revisit has no payload; an
    empty folder has no rows; a file that breaks off or holds something else is an error. Large files of our own writer are read in ranges,
    others in one piece.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("splitBytes", split_bytes).load(path)


def round_trip(pages: DataFrame, out_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages' records, written and read back.

    Digest and size of a response are taken from the payload that was read, those of a revisit from its header.
    """
    write_archives(pages, out_dir)
    found = read_archives(pages.sparkSession, out_dir).where(F.col("record_type").isin("response", "revisit"))
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.url_decode(F.nullif(F.regexp_extract(c, r"^<urn:page:([^:]*):\d+>$", 1), F.lit(""))).cast(kind)
    own = F.col("record_type") == "response"
    return found.select(
        page("record_id").alias("page_id"), F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_sha1")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )


def oracle_sql() -> str:
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT *, strlen(html) AS n, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= {MIN_REVISIT} AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= {MIN_REVISIT} AND r > 1 THEN top END AS refers_to FROM k"""
