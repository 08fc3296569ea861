"""Token counts as additive rollups, maintained by signed changes in idempotent batches.

A change is a signed row (source, lang, tokenizer, n_docs, n_tokens, n_chars): an insert
adds a document, a delete takes away the counts it had, a revision takes away the old and adds the new.
A batch of changes is summed by source, language and tokenizer version, and written under a name of its own; then a
small record ``batch=<id>`` that names it is created, if there is none yet. The record is the commit: a batch that is
tried again, by a restarted job or a second driver, counts once, and one that fails before it leaves nothing that is read.

Totals are the sum of the batches. ``compact`` sums those committed into one table and then creates a record
``base=<n>`` with their ids; a reader takes records from one listing, so it sees either the batches or the base. Tables
that a base has replaced stay until ``vacuum``, so readers at work aren't disturbed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import hadoop_path, publish_text, read_text, remove
from noteloom.llm.sentencepieces import ChunkTable, check_model

KEY = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def count_tokens(docs: DataFrame, model_path: str, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_chars of each whole text; null and empty texts have 0 of both.

    Null ids, sources and languages stay; repeated rows are counted as often as they occur; other columns, of any name,
    are ignored; an empty table gives an empty result; texts may be of any length.
    """
    check_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(3)), 0).cast(pa.int64())
            for lo, hi, _, at in table.encode_column(batch.column(3)):
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
                cols += [pa.array([tokenizer] * (hi - lo)), pa.array(np.diff(at)), chars.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_chars"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")


def inserts(counted: DataFrame) -> DataFrame:
    """Signed rows that add the counted documents."""
    return _signed(counted, 1)


def deletes(counted: DataFrame) -> DataFrame:
    """Signed rows that take away documents with the counts they were added with."""
    return _signed(counted, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that replace counts; both sides have a row for each revised document."""
    return deletes(before).union(inserts(after))


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that turn the counted table ``before`` into ``after``, from their differing rows only.

    Rows are matched as a whole, as multisets, so repeated rows and null ids are handled too.
    """
    cols = ["doc_id", *KEY, "n_tokens", "n_chars"]
    signed = before.select(*cols, F.lit(-1).alias("s")).union(after.select(*cols, F.lit(1).alias("s")))
    net = signed.groupBy(*cols).agg(F.sum("s").alias("s")).where("s <> 0")
    return net.select(*KEY, F.col("s").alias("n_docs"), (F.col("s") * F.col("n_tokens")).alias("n_tokens"), (F.col("s") * F.col("n_chars")).alias("n_chars"))


def _signed(counted: DataFrame, sign: int) -> DataFrame:
    s = F.lit(sign).cast("long")
    return counted.select(*KEY, s.alias("n_docs"), (s * F.col("n_tokens")).alias("n_tokens"), (s * F.col("n_chars")).alias("n_chars"))


class TokenRollup:
    """Committed totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _records(self) -> tuple[dict | None, dict[str, dict]]:
        """The newest base record and all batch records, of one listing."""
        fs, root = hadoop_path(self.spark, f"{self.path}/records")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        bases = sorted(n for n in names if re.fullmatch(r"base=\d+", n))
        read = lambda n: json.loads(read_text(self.spark, f"{self.path}/records/{n}"))
        base = read(bases[-1]) | {"number": int(bases[-1].split("=")[1])} if bases else None
        done = set(base["batches"]) if base else set()
        batches = [n.split("=", 1)[1] for n in names if n.startswith("batch=") and not n.endswith(".tmp")]
        return base, {b: read(f"batch={b}") for b in batches if b not in done}

    def committed(self) -> set[str]:
        """Ids of all batches that count."""
        base, batches = self._records()
        return set(batches) | set(base["batches"] if base else ())

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed rows; False, with nothing changed, if the batch is committed already.

        Rows are pre-aggregated before they are shuffled, so a hot source is no hot task. An empty batch
        is committed too. Null sources and languages are keys like others.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.endswith(".tmp"):
            raise ValueError("a batch id is made of letters, digits, '_', '.' and '-'")
        if batch in self.committed():
            return False
        return self._publish(f"batch={batch}", _sum(signed), {})

    def _publish(self, name: str, rows: DataFrame, record: dict) -> bool:
        """Write a table, then create the record that makes it count; without a trace if there is one of that name."""
        table = f"table-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{table}")
        if publish_text(self.spark, f"{self.path}/records/{name}", json.dumps(record | {"table": table})):
            return True
        remove(self.spark, f"{self.path}/{table}")
        return False

    def _rows(self, base: dict | None, batches: dict[str, dict]) -> DataFrame:
        tables = [r["table"] for r in ([base] if base else []) + list(batches.values())]
        if not tables:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{t}" for t in tables])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer and the sums over all committed batches; keys whose sums are 0 are left out."""
        return _sum(self._rows(*self._records())).where(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> bool:
        """Sum all committed batches into a new base table; the totals don't change. False if another driver was first."""
        base, batches = self._records()
        ids = sorted({*(base["batches"] if base else ()), *batches})
        tables = [r["table"] for r in ([base] if base else []) + list(batches.values())]
        number = base["number"] + 1 if base else 0
        return self._publish(f"base={number:08d}", _sum(self._rows(base, batches)), {"batches": ids, "replaced": tables})

    def vacuum(self) -> None:
        """Remove the tables that any base has replaced; call it when no reader is at work on them."""
        fs, root = hadoop_path(self.spark, f"{self.path}/records")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        for name in names:
            if re.fullmatch(r"base=\d+", name):
                for table in json.loads(read_text(self.spark, f"{self.path}/records/{name}"))["replaced"]:
                    remove(self.spark, f"{self.path}/{table}")


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
