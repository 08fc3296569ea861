"""Staging, side-file filtering and Arrow text access."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noteloom.llm import common
from noteloom.llm.textvec import shingles, span_hash, word_spans


def test_rows_kept_and_release(spark):
    table = common.staged(spark.range(0, 1000, 1, 7).select(F.col("id").alias("v")).withColumn("__uid", F.monotonically_increasing_id()), "t")
    some = table.where("v % 3 = 0").select("__uid")
    kept = common.rows_kept(table, some, [F.col("v")])
    assert sorted(r.v for r in kept.collect()) == list(range(0, 1000, 3))
    assert common.rows_kept(table, some.where("false"), [F.col("v")]).count() == 0
    fs, path = common.hadoop_path(spark, table.inputFiles()[0])
    mine = common.staged(spark.range(3), "kept", keep=True)
    assert fs.exists(path)
    common.release(spark)
    assert not fs.exists(path) and mine.count() == 3


def test_text_buffers_take_slices_nulls_and_wide_strings():
    a = pa.array(["xx", "ab", None, "", "é"])
    for col in (a.slice(1), a.slice(1).cast(pa.large_string()), pa.chunked_array([a.slice(1, 2), a.slice(3)])):
        buf, offs = common.text_buffers(col)
        assert [buf[x:y].tobytes().decode() for x, y in zip(offs[:-1], offs[1:], strict=True)] == ["ab", "", "", "é"]
    assert common.text_buffers(pa.array([], pa.string()))[1].tolist() == [0]
    assert list(common.row_slices(np.array([0, 5, 5, 50, 51]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_words_and_shingles_are_those_of_the_definition():
    texts = ["a b  c\td e f", "", "one", "x y z", "a b c d e f", "é è ü"]
    buf, offs = common.text_buffers(pa.array(texts))
    s, e, row = word_spans(buf, offs)
    assert [buf[x:y].tobytes().decode() for x, y in zip(s, e, strict=True)] == ["a", "b", "c", "d", "e", "f", "one", "x", "y", "z", "a", "b", "c", "d", "e", "f", "é è", "ü"]
    h, owner = shingles(span_hash(buf, s, e), row, len(texts), 5)
    assert owner.tolist() == [0, 0, 2, 3, 4, 4, 5] and h[:2].tolist() == h[4:6].tolist() and len(set(h.tolist())) == 5


def test_long_words_hash_by_content():
    text = ("w" * 3_000_000 + " ") * 2 + "w" * 2_999_999
    buf, offs = common.text_buffers(pa.array([text]))
    h = span_hash(buf, *word_spans(buf, offs)[:2])
    assert h[0] == h[1] != h[2]
