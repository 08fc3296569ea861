"""What the findings of a round named: whole jobs, and steps whose work grows with the input only."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from noteloom.errors import EngineError
from noteloom.operators import merge
from noteloom.operators.postings import bucket_postings, local_tokens, local_vectors, norms, token_counts
from noteloom.operators.search import best_notes
from noteloom.operators.store import OPS, NoteStore
from noteloom.plans import state_queries
from noteloom.sources import vault
from noteloom.streaming.folds import newest

SF = "/root/testdata/sf0.001"


def test_memory_rank_scores_every_customer(spark):
    """Each customer holds a word of the query, so none is left to a default score."""
    assert {r.score for r in state_queries.memory_rank(spark, SF).collect()} == {1, 3, 5}


def _shuffled(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_postings_are_made_without_a_shuffle(spark):
    """The rows of the joins and groupings that they stand for: repeats, non-ASCII text, no text, long and short words."""
    texts = ["a bb ccc bb", "", None, "Ünï KELVIN K İx ſ " + "z" * 300, "one two 12 " * 40, "a", "-- ??"]
    rows = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(texts * 3)], "id string, text string")
    tokens, vectors = local_tokens(rows), local_vectors(rows)
    assert "Exchange" not in _shuffled(tokens) and "Exchange" not in _shuffled(vectors)
    counts = token_counts(rows)
    assert sorted(map(tuple, tokens.drop("folder").collect())) == sorted(map(tuple, counts.select("token", "id", "n").collect()))
    plain = bucket_postings(counts)
    assert sorted(map(tuple, vectors.collect())) == sorted(map(tuple, plain.join(norms(plain), "id").select("bucket", "id", "tf", "squared").collect()))


def test_differences_of_texts_of_many_words_go_by_words_that_come_once(monkeypatch):
    """What changed at both ends of a text of some hundred words isn't searched for by comparing all its words with all."""
    compared = []
    plain = merge.SequenceMatcher
    monkeypatch.setattr(merge, "SequenceMatcher", lambda junk, x, y, autojunk: compared.append(len(x) * len(y)) or plain(junk, x, y, autojunk=autojunk))
    old = " ".join(f"w{i % 150 if i % 3 else i}" for i in range(400))
    parts = merge.splices(f"«a {old} b›", f"[a {old} c]")
    assert sum(n for _, n, _ in parts) <= 4 and sum(len(t) for _, _, t in parts) <= 4
    assert max(compared) <= merge.DIRECT**2
    same = "to be or not " * 60  # no word comes once
    assert sum(n for _, n, _ in merge.splices(f"« {same} ›", f"[ {same} ]")) <= 4


def test_merging_takes_many_notes_in_a_task(spark):
    first = merge.first_ops(spark.createDataFrame([("a", "x")], "note_id string, text string"))
    for plan in (_shuffled(merge.merged(first)), _shuffled(merge.edits(first, first.select("note_id", "text"), "c"))):
        assert "InArrow" in plan and "GroupsInArrow" not in plan and "CoGroup" not in plan


def test_best_notes_shuffle_texts_once_and_no_postings(spark):
    texts = spark.createDataFrame([(i, f"alpha {'beta ' * i}") for i in range(4)] + [(9, None)], "id long, text string")
    asked = spark.createDataFrame([("p", "beta"), ("q", "alpha zzz"), ("r", "zzz")], "query_id string, text string")
    found = best_notes(texts, asked)
    assert sorted(map(tuple, found.collect())) == [("p", 3, 3), ("q", 0, 1)]
    assert _shuffled(found).split("Initial Plan")[0].count("Exchange hashpartitioning") == 2


def test_stateful_folds_get_the_newest_rows_of_a_task_only(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 3, 1, "y"), ("a", 3, 1, "z"), ("a", 3, 0, "v"), (None, 2, 2, "n"), ("b", 0, 0, None)] * 50, "key string, ts long, seq long, value string").coalesce(1)
    late = newest(rows, "key", [("ts", "descending"), ("seq", "descending")], True)
    assert sorted(map(str, late.collect())) == sorted(map(str, [Row(key="a", ts=3, seq=1, value="z"), Row(key=None, ts=2, seq=2, value="n"), Row(key="b", ts=0, seq=0, value=None)]))
    early = newest(rows, "key", [("ts", "descending"), ("seq", "ascending")], False)
    assert {(r.key, r.value) for r in early.collect()} == {("a", "v"), (None, "n"), ("b", None)}
    assert newest(rows.where("ts > 9"), "key", [("ts", "descending")], True).count() == 0


def test_audit_log_of_several_files_is_in_their_order(spark, tmp_path):
    """Small later files and a large earlier one, which Spark's readers take first."""
    for name, ids in (("part-00000", range(0, 500)), ("part-00001", range(500, 502)), ("part-00002", range(502, 550))):
        (tmp_path / f"{name}-x.txt").write_text("".join(f'{{"action": "a", "version_id": "{i}"}}\n' for i in ids) + "broken\n")
    assert [int(r.version_id) for r in vault.audit_log(spark, f"file://{tmp_path}", 60).collect()] == list(range(549, 489, -1))


def test_files_are_written_without_copies_of_whole_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a/ü.md", "tëxt"), ("b.md", ""), ("c.md", None)], "path string, raw string")
    assert vault.write_files(rows, f"file://{tmp_path}") == 3 and (tmp_path / "a/ü.md").read_text() == "tëxt" and (tmp_path / "b.md").read_text() == ""
    assert vault.write_files(rows.selectExpr("path", "cast(null as binary) raw"), f"file://{tmp_path}") == 3 and not list(tmp_path.rglob("*.md"))


def test_a_table_of_ops_is_stored_once_and_texts_are_not_shuffled_for_links_or_digests(spark, tmp_path):
    """Overlays of bulk changes, renames and reverts are columns of the histories; a rename's ops hold no texts but the renamed note's."""
    s = NoteStore(spark, f"file://{tmp_path}/s")
    files = {"x/hub": "me [[hub]]", "y/Hub": "no", **{f"n{i}": f"---\nk: {i}\n---\n[[HUB]] and [[x/hub#a|b]] and [[y/Hub]] {i}" for i in range(6)}}
    s.load(spark.createDataFrame(list(files.items()), "note_id string, raw string"))
    ops = spark.createDataFrame([(1, "update", "n0", "first", None, None), (2, "setraw", "n0", None, None, "last"), (3, "delete", "n1", None, None, None), (4, "setraw", "new", None, None, "")], OPS)
    s.apply_many(ops)
    want = {k: v for k, v in files.items() if k != "n1"} | {"n0": "last", "new": ""}
    assert {r.note_id: r.raw for r in s.raw().collect()} == want
    assert {r.note_id: r.n for r in s.each(n=F.length("raw")).collect()} == {k: len(v) for k, v in want.items()}
    held = s.rename_ops("x/hub", "z").collect()
    assert {r.note_id: r.content for r in held} == {"z": "me [[z]]", "x/hub": None, "n2": None, "n3": None, "n4": None, "n5": None}
    done = s.rename("x/hub", "z")
    assert done["links_updated_in"] == 4
    moved = {r.note_id: r.raw for r in s.raw().collect()}
    assert moved == {k: v for k, v in want.items() if k not in ("x/hub", "n2", "n3", "n4", "n5")} | {"z": "me [[z]]\n"} | {f"n{i}": f"---\nk: {i}\n---\n[[z]] and [[z#a|b]] and [[y/Hub]] {i}\n" for i in range(2, 6)}
    s.revert(done["version_id"])
    assert {r.note_id: r.raw for r in s.raw().collect()} == want and len(s.files.names("data")) == 1
    assert {r.note_id for r in s.table.changed_since(2).collect()} == {"x/hub", "z", "n2", "n3", "n4", "n5"}
    s.vacuum(1)
    assert s.raw().count() == len(want)
    # an earlier op of a note that can't be done refuses the set, whatever the last one is
    with pytest.raises(EngineError) as e:
        s.apply_many(spark.createDataFrame([(1, "create", "n2", "x", None, None), (2, "update", "n2", "y", None, None)], OPS))
    assert e.value.code == "CONFLICT" and "'n2'" in str(e.value)


def test_merged_texts_are_shuffled_once_whatever_the_clients(spark):
    """Texts move to the ops of four clients once, and stay there for what one of them types after it; differences alone are written."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = state_queries.text_merge(spark, SF)
        plan = _shuffled(out).split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") <= 3  # ops by note, those by the key of the join, and the notes
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        want = docs.selectExpr("'d/' || doc_id", "'[a ' || substr('.' || coalesce(text, ''), 5) || ' ‹e› ‹b› a]' t").selectExpr("*", "md5(t)", "length(t)").drop("t")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ops_are_received_by_the_notes_that_are_known(spark):
    notes = merge.opened(spark.createDataFrame([("n1", "one two"), ("n2", None), (None, "three"), ("n4", "four")], "note_id string, text string"))
    drafts = notes.withColumn("text", F.concat(F.lit("«"), F.col("ops")[0]["text"]))
    a = merge.sent(merge.typed(drafts, "a", ["note_id"]))
    b = merge.sent(merge.typed(notes.where("note_id = 'n1'").withColumn("text", F.lit("one 2")), "b", ["note_id"]))
    assert {r.kind for r in a.collect()} == {"ins"} and max(len(r.text) for r in a.collect()) == 1
    other = b.withColumn("note_id", F.lit("unknown"))
    for ops in (a.union(b).union(other), b.union(other).union(a).union(b)):
        out = merge.shown(merge.received(notes, ops), ["note_id"])
        assert {r.note_id: r.text for r in out.collect()} == {"n1": "«one 2", "n2": "«", None: "«three", "n4": "«four"}
    assert {r.text for r in merge.shown(merge.received(notes, a.where("false")), ["note_id"]).collect()} == {"one two", "", "three", "four"}
