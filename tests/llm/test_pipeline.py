"""The pipeline against a brute-force version of its stages."""

import hashlib
import re

import corpus_pipeline
from noteloom.llm import mixing, pii, queries, quality_rules, sentencepieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "pii_surrogates", "source_mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())

    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    rows = sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.collect() if r.doc_id in kept)
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for k, i in enumerate(order):
        for j in order[:k]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    first = {find(i) for i in order}
    assert len(first) < len(rows) or len(first) == len(rows)
    left = spark.createDataFrame([r for r in rows if r[0] in first], "doc_id long, text string, lang string, source string")
    # surrogates and counts have tests of their own; the tokens are the library's
    mixed = mixing.mix(pii.pseudonymise(left, queries.SURROGATE_KEY)).collect()
    model = sentencepieces.load_model(queries.piece_model())
    want = []
    for r in mixed:
        ids = model.encode(r.text)
        decoded = model.decode(ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want) and got


def test_stages_return_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_run_takes_nulls_ties_long_texts_and_clashing_names(spark, tmp_path):
    good = " ".join(f"{w}{i}" for i in range(30) for w in ("alpha", "beta", "gamma"))
    long = " ".join(f"word{i % 7919} text{i}" for i in range(40_000))
    rows = [(1, good, "en", "a", 90, "x"), (1, good, "en", "a", 90, "x"), (2, good, "en", "b", 90, "x"), (None, long, None, None, None, None), (4, None, "en", "a", 0, "y"), (5, "", None, "a", 0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __uid string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in got} <= {1, None} and all(r.n_tokens > 50 for r in got)
    df.where("false").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
