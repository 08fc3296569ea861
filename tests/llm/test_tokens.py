"""SentencePiece chunks, token rollups and shards against the library and plain recounts."""

import collections
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteloom.llm import common, rollup, sentencepieces, shards
from noteloom.llm.queries import piece_model

TEXTS = [
    "plain words here", "", None, " ", "  two  spaces ", "a\n\tb  c", "▁ literal ▁marker", "é▁b c", "日本語 テスト 🎉🎉 ok", "x" * 5000, "\x00 nul", "same same same", "same same same",
    "end ", " front", "q" * 40 + " " + "q" * 41, "line\nbreaks\r\nand\ttabs",
]


@pytest.fixture(scope="module")
def model():
    return sentencepieces.load_model(piece_model())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "en", "s", "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_tokens string")


def test_ids_and_text_equal_the_library(docs, model):
    rows = sentencepieces.encode_decode(docs, piece_model()).collect()
    assert len(rows) == len(TEXTS)
    by_text = {}
    for t in TEXTS:
        ids = model.encode(t or "")
        by_text[hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] = (ids, model.decode(ids) if ids else "")
    for r in rows:
        ids, decoded = by_text[r.ids_sha256]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == decoded
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" ab▁é\n日.1"), max_size=40), min_size=1, max_size=8))
def test_any_text(texts):
    import pyarrow as pa

    table = sentencepieces.ChunkTable(piece_model(), 5)
    got = [ids[a:b].tolist() for _, _, ids, at in table.encode_column(pa.array(texts)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [table.model.encode(t) for t in texts]


def test_empty_table(docs):
    assert sentencepieces.encode_decode(docs.where("false"), piece_model()).count() == 0


def test_spaced_chunks_are_segmented_once(model, monkeypatch):
    table = sentencepieces.ChunkTable(piece_model())
    code = "def f(x):\n    if x:\n        return  x\n" * 300 + " tail  "
    assert table._plain(code).tolist() == model.encode(code)
    asked = []
    real = table.model.encode
    monkeypatch.setattr(table.model, "encode", lambda chunks, **k: asked.extend(chunks) or real(chunks, **k), raising=False)
    assert table._plain(code + "  new").tolist() == model.encode(code + "  new") and asked == ["   new"]
    table.limit = 2
    assert [table._plain(t).tolist() for t in (code, "  a  b   c ", code)] == [model.encode(t) for t in (code, "  a  b   c ", code)]


def test_other_models_are_refused(tmp_path, model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(piece_model(), "rb").read())
    proto.pieces[400].piece = "x▁y"
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        sentencepieces.check_model(str(tmp_path / "m.model"))


def test_rollup_commits_once_and_follows_changes(spark, docs, model, tmp_path):
    store = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0
    counted = rollup.count_tokens(docs, piece_model(), "v1").cache()
    assert store.commit("b1", rollup.inserts(counted)) and not store.commit("b1", rollup.inserts(counted))
    want = sum(len(model.encode(t or "")) for t in TEXTS)
    r = store.totals().first()
    assert (r.n_docs, r.n_tokens, r.n_chars) == (len(TEXTS), want, sum(len(t or "") for t in TEXTS))
    gone = counted.where("doc_id IN (0, 9)")
    assert store.commit("b2", rollup.deletes(gone))
    before = counted.where("doc_id = 5")
    after = before.withColumn("n_tokens", F.lit(7).cast("long")).withColumn("source", F.lit("t"))
    assert store.commit("b3", rollup.revisions(before, after))
    now = {x.source: x for x in store.totals().collect()}
    lost = sum(len(model.encode(TEXTS[i])) for i in (0, 9, 5))
    assert now["s"].n_docs == len(TEXTS) - 3 and now["s"].n_tokens == want - lost and now["t"].n_tokens == 7
    totals = sorted(map(tuple, store.totals().collect()))
    store.compact()
    assert sorted(map(tuple, store.totals().collect())) == totals and not store.commit("b2", rollup.deletes(gone))
    assert store.commit("b4", rollup.changes_between(counted, counted)) and sorted(map(tuple, store.totals().collect())) == totals
    with pytest.raises(ValueError):
        store.commit("../x", rollup.inserts(counted))


def test_rollup_query_is_a_recount_of_the_final_state(spark, model):
    from noteloom.llm import queries

    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic, bad = {r.doc_id for r in labels if r.toxic == 1}, {r.doc_id for r in labels if r.quality == 0}
    want = collections.defaultdict(lambda: [0, 0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.doc_id not in toxic:
            text = re.sub(r"[ \t\n\x0b\f\r]+", " ", r.text or "") if r.doc_id in bad else r.text or ""
            for i, v in enumerate((1, len(model.encode(text)), len(text))):
                want[r.source, r.lang][i] += v
    assert toxic and bad - toxic
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in queries.op6_token_rollup(spark, sf).collect()}
    assert got == dict(want)


def test_rollup_survives_a_stop_between_any_two_steps(spark, docs, tmp_path, monkeypatch):
    store = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    counted = rollup.count_tokens(docs, piece_model(), "v1").cache()
    store.commit("a", rollup.inserts(counted))
    store.commit("b", rollup.inserts(counted))
    totals = sorted(map(tuple, store.totals().collect()))

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(rollup, "publish_text", stop)
        for step in (lambda: store.commit("c", rollup.inserts(counted)), store.compact):
            with pytest.raises(OSError):
                step()
    assert store.committed() == {"a", "b"} and sorted(map(tuple, store.totals().collect())) == totals
    reader = store.totals()  # planned before the compaction, run after it
    # another driver compacts first: this one changes nothing
    with monkeypatch.context() as m:
        real = rollup.publish_text

        def late(spark_, path, text):
            m.setattr(rollup, "publish_text", real)
            assert rollup.TokenRollup(spark, store.path).compact()
            return real(spark_, path, text)

        m.setattr(rollup, "publish_text", late)
        assert not store.compact()
    assert sorted(map(tuple, reader.collect())) == totals == sorted(map(tuple, store.totals().collect()))
    assert rollup.publish_text(spark, f"{store.path}/records/base=00000000", "{}") is False
    store.vacuum()
    assert sorted(map(tuple, store.totals().collect())) == totals and store.committed() == {"a", "b"} and not store.commit("a", rollup.inserts(counted))


def test_counts_take_very_long_texts_and_clashing_names(spark, model):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, long, "en", "s", 5), (1, long, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_tokens int")
    rows = rollup.count_tokens(df, piece_model(), "v1").collect()
    assert [(r.n_tokens, r.n_chars) for r in rows] == [(len(model.encode(long)), len(long))] * 2


def test_rollup_keeps_null_keys_and_empty_tables(spark, tmp_path):
    store = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    docs = spark.createDataFrame([(1, "a b", None, None)], "doc_id long, text string, lang string, source string")
    counted = rollup.count_tokens(docs, piece_model(), "v1")
    store.commit("a", rollup.inserts(counted))
    store.commit("b", rollup.inserts(counted.where("false")))
    assert [tuple(r) for r in store.totals().collect()] == [(None, None, "v1", 1, 2, 3)]
    store.commit("c", rollup.deletes(counted))
    assert store.totals().count() == 0


def test_feistel_permutes():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        out = shards.feistel(np.arange(n), n, 5)
        assert sorted(out.tolist()) == list(range(n))
    assert shards.feistel(np.arange(1000), 1000, 5).tolist() != shards.feistel(np.arange(1000), 1000, 6).tolist()


def test_shards_hold_the_stream_in_permuted_order(spark, model, tmp_path):
    texts = [f"text number {i} " * (i % 37) for i in range(300)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(3)
    out = f"file://{tmp_path}/shards"
    rows = shards.write_shards(docs, piece_model(), out, key=9, length=16, per_shard=50).collect()
    stream = [x for r in docs.collect() for x in [*model.encode(r.text or ""), model.eos_id()]]
    n = -(-len(stream) // 16)
    assert sorted(r.slot for r in rows) == list(range(n)) and sorted(r.seq for r in rows) == list(range(n))
    stored = [s.tolist() for s in shards.read_slots(out, 0, n + 5, length=16, per_shard=50)]
    assert len(stored) == n
    padded = stream + [model.eos_id()] * (n * 16 - len(stream))
    for r in rows:
        want = padded[r.seq * 16 : r.seq * 16 + 16]
        assert stored[r.slot] == want and r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 32
        assert r.sha256 == hashlib.sha256(np.array(want, "<u2").tobytes()).hexdigest()
    assert [s.tolist() for s in shards.read_slots(out, 45, 10, length=16, per_shard=50)] == stored[45:55]
    assert shards.write_shards(docs.where("false"), piece_model(), out + "2", key=9).count() == 0


def test_shards_take_repeated_rows_long_texts_and_clashing_names(spark, model, tmp_path):
    long = "word " * 30_000
    docs = spark.createDataFrame([(1, long, 7, "x"), (1, long, 7, "x"), (None, "a b", None, None)], "doc_id long, text string, slot int, seq string").coalesce(1)
    rows = shards.write_shards(docs, piece_model(), f"file://{tmp_path}/s", key=3, length=64, per_shard=100).collect()
    total = sum(len(model.encode(r.text)) + 1 for r in docs.collect())
    assert len(rows) == -(-total // 64) and sorted(r.slot for r in rows) == list(range(len(rows))) and sum(r.n_tokens for r in rows) == total


def test_vacuum_leaves_the_tables_of_the_newest_base_only(spark):
    store = rollup.TokenRollup(spark, common.new_dir(spark, "rollup"))
    rows = spark.createDataFrame([("s", "l", "t", 1, 2, 3)], rollup._SCHEMA)
    for batch in "ab":
        store.commit(batch, rows)
        store.compact()
    want = sorted(map(tuple, store.totals().collect()))
    store.vacuum()
    fs, root = common.hadoop_path(spark, store.path)
    assert len([s for s in fs.listStatus(root) if s.getPath().getName().startswith("table-")]) == 1
    assert sorted(map(tuple, store.totals().collect())) == want
