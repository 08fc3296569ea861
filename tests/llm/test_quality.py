"""Quality rules against the SQL oracle and by hand; the classifier by held-out accuracy."""

import duckdb
import numpy as np
import pytest

from noteloom.llm import quality_gam, quality_rules

GOOD = "the old river runs past {} houses and {} gardens where people often sit and talk about {} things that happened in the town during the long {} years before the bridge was built by workers who came from far away and stayed because they liked {} very much and found good land there for their many {} children"


def rows():
    out = [(i, GOOD.format(*[f"w{i * 7 + k}" for k in range(6)]), "en", "a" if i % 3 else "b") for i in range(260)]
    junk = [(1000, " ".join(f"x{k}###" for k in range(80)), "en", "a"), (1001, "go " * 90, "en", "b"), (1002, "short text", "de", None), (1003, None, None, None), (1004, "", "en", "a"), (1005, "w\nw\n\nw\n w" + " z" * 3, "en", "a")]
    return out + junk + [(5, out[5][1], "en", "a"), (None, out[6][1], None, "q"), (1006, "😀 é ü " * 2, "fr", "q")]


def oracle(spark, data, tmp_path):
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"file://{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cur = con.execute(quality_rules.oracle_sql())
    names = [d[0] for d in cur.description]
    return df, names, sorted(cur.fetchall(), key=str)


def test_rules_equal_oracle(spark, tmp_path):
    df, names, want = oracle(spark, rows(), tmp_path)
    got = sorted((tuple(r) for r in quality_rules.judge(df.withColumn("kept", df.lang)).select(*names).collect()), key=str)
    assert got == want
    kept = {r[0] for r in got if r[names.index("kept")]}
    assert kept >= set(range(260)) and not kept & {1000, 1001, 1002, 1003, 1004, 1005, 1006}


def test_filter_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(*r, "extra") for r in rows()], "doc_id long, text string, lang string, source string, n_words string")
    out = quality_rules.filter_documents(df)
    assert out.columns == df.columns and out.count() == 262 and out.where("n_words <> 'extra'").count() == 0
    assert quality_rules.filter_documents(df.where("false")).count() == 0
    assert quality_rules.judge(df.where("doc_id > 1000")).where("kept").count() == 0


def test_sketches_merge(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    m = quality_rules.measure(df, ["doc_id", "lang", "source"]).cache()
    whole = quality_rules.sketches(m)
    halves = quality_rules.sketches(m.where("doc_id % 2 = 0 OR doc_id IS NULL")).union(quality_rules.sketches(m.where("doc_id % 2 = 1")))
    key = ["lang", "source"]
    a = sorted(map(tuple, quality_rules.fences(whole).orderBy(*key).collect()), key=str)
    assert a == sorted(map(tuple, quality_rules.fences(halves).orderBy(*key).collect()), key=str)


def test_fences_follow_the_habits_of_sources(spark, tmp_path):
    """Two sources of one size: plain prose, and tables with many symbols, repeats and equal lines; each gets fences of its own."""
    rng = np.random.default_rng(3)
    word = lambda k: "".join(rng.choice(list("abcdefgh"), k))
    prose = [" ".join(word(rng.integers(4, 7)) for _ in range(100)) for _ in range(400)]
    dense = []
    for _ in range(400):
        line = " ".join(word(12) for _ in range(4))
        lines = [" ".join(word(12) for _ in range(5)) for _ in range(20)] + [line] * int(rng.integers(2, 10))
        dense.append("\n".join(lines) + " " + "| " * int(rng.integers(5, 60)))
    odd = prose[0] + " |" * 60
    data = [(i, t, "en", "prose") for i, t in enumerate([*prose, odd, dense[0]])] + [(1000 + i, t, "en", "tables") for i, t in enumerate([*dense, odd])]
    df, names, want = oracle(spark, data, tmp_path)
    assert sorted((tuple(r) for r in quality_rules.judge(df).select(*names).collect()), key=str) == want
    kept = {r[names.index("doc_id")] for r in want if r[names.index("kept")]}
    assert kept >= set(range(400)) and kept >= set(range(1000, 1400)) and not kept & {400, 401}
    m = quality_rules.measure(df, ["doc_id", "lang", "source"])
    f = {r.source: r for r in quality_rules.fences(quality_rules.sketches(m)).collect()}
    assert all(f["tables"][b] != f["prose"][b] for b in quality_rules._bounds())
    assert f["tables"].symbols_hi > 3 * f["prose"].symbols_hi


def test_rules_take_very_long_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, base_failed string"
    long = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, long, "en", "a", "x"), (1, long, "en", "a", "x"), (2, "a\n" * 100_000, "en", "a", None)], schema)
    got = {(r.doc_id, r.n_words, r.kept) for r in quality_rules.judge(df).collect()}
    assert got == {(1, 300_000, True), (2, 100_000, False)}
    assert quality_rules.judge(df.where("false")).count() == 0


def test_classifier_held_out(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_gam.train(docs, labels)
    out = quality_gam.score(docs, model).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    pos, neg = out.score[out.quality == 1].to_numpy(), out.score[out.quality == 0].to_numpy()
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert auc > 0.95 and (out.predicted == out.quality).mean() > 0.9
    # labels of held-out rows don't matter
    other = labels.withColumn("quality", F.when(quality_gam.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_gam.train(docs, other)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))


def test_scores_equal_a_plain_loop_over_the_tables(spark):
    """The query's rows, brute force: held out by zlib's checksum, scores by one lookup after the other."""
    import math
    import zlib

    import pyarrow as pa

    from noteloom.llm import queries
    from noteloom.llm.common import text_buffers

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_gam.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op4_quality_gam(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        (x,) = quality_gam.features_of(*text_buffers(pa.array([r.text or ""])))
        bins = [sum(1 for cut in e if cut <= v) for e, v in zip(model.edges, x, strict=True)]
        margin = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        for i, j, t in model.pairs:
            margin += t[bins[i] * quality_gam.PAIR_BINS // (len(model.edges[i]) + 1)][bins[j] * quality_gam.PAIR_BINS // (len(model.edges[j]) + 1)]
        want = 1 / (1 + math.exp(-max(-30, min(30, margin))))
        g = got[r.doc_id]
        assert abs(g.score - want) < 1e-9 and g.predicted == (g.score >= 0.5) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "some text", 3), (4, "word " * 30000, 4), (4, "again", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality_gam.train(docs, labels)
    got = quality_gam.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = quality_gam.train(docs, labels.where("false"))
    assert {r.score for r in quality_gam.score(docs, none).collect()} == {0.5}
    assert quality_gam.score(docs.where("false"), none).count() == 0


def test_fit_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, len(quality_gam.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit(x, y)
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs) and ((model.score(x) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("y", [np.zeros(0), np.ones(5)])
def test_fit_without_both_labels(y):
    model = quality_gam.fit(np.zeros((len(y), len(quality_gam.FEATURES)), np.float32), y)
    assert len(set(model.score(np.zeros((3, len(quality_gam.FEATURES)), np.float32)))) == 1
