import json

from noteloom.operators.store import NoteStore
from noteloom.sources.layers import LayeredTable
from noteloom.sources.log import SequencedLog
from noteloom.sources.logsource import follow
from noteloom.sources.places import Files
from noteloom.streaming import sync
from noteloom.streaming.apply import Applier


def made(spark, tmp_path, notes):
    store = NoteStore(spark, f"file://{tmp_path}/store")
    applier = Applier(spark, f"file://{tmp_path}/applier", store)
    rows = spark.createDataFrame([(k, v, 0) for k, v in notes.items()], "note_id string, raw string, seq long")
    store.load(rows.select("note_id", "raw"))
    applier.in_step(rows)
    return store, applier


def rows_of(spark, *changes):
    return spark.createDataFrame([(seq, json.dumps([{"note_id": k, "raw": v}]).encode()) for seq, k, v in changes], "seq long, blob binary")


def raws(store):
    return {r.note_id: r.raw for r in store.raw().collect()}


def test_newest_change_of_each_note_and_local_edits_first(spark, tmp_path):
    store, applier = made(spark, tmp_path, {"a": "1", "b": "1", "c": "1"})
    store.apply([{"op": "setraw", "note_id": "b", "raw": "mine"}])
    applier.take(rows_of(spark, (1, "a", "2"), (2, "a", "3"), (3, "b", "theirs"), (4, "c", None), (5, "d", "new")), 0)
    assert raws(store) == {"a": "3", "b": "mine", "d": "new"} and [r.note_id for r in applier.pending().collect()] == ["b"]
    version = store.audit_log(1).first()
    assert sorted(version.notes) == ["a", "c", "d"]  # one version for the batch
    applier.take(rows_of(spark, (1, "a", "2")), 1)  # an old change that comes again
    assert raws(store)["a"] == "3"
    applier.in_step(spark.createDataFrame([("b", "mine", 2)], "note_id string, raw string, seq long"))
    assert applier.flush() == {"applied": 1, "waiting": 0} and raws(store)["b"] == "theirs" and not applier.files.names("inbox")


def test_many_changes_pass_the_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "BULK", 5)
    store, applier = made(spark, tmp_path, {})
    applier.take(rows_of(spark, *[(i, f"n{i}", "x") for i in range(1, 6)]), 0)
    assert store.audit_log().count() == 1
    applier.take(rows_of(spark, *[(i, f"n{i}", "y") for i in range(10, 20)]), 1)
    assert store.audit_log().count() == 1 and len(raws(store)) == 15


def test_a_stop_between_any_two_steps_ends_in_the_same_state(spark, tmp_path, monkeypatch):
    """Each step of a batch is made to fail in turn, before and after it is done; the batch comes again."""
    from noteloom.streaming import apply

    want = {"a": "2", "b": "mine", "d": "new"}
    steps = [(Applier, "queue", False), (Applier, "queue", True), (apply, "written", False), (Applier, "_write", True), (Applier, "_remember", True), (Files, "delete", True)]
    for i, (owner, name, late) in enumerate(steps):
        here = tmp_path / f"{i}{late}"
        store, applier = made(spark, here, {"a": "1", "b": "1", "c": "1"})
        store.overlay_many(spark.createDataFrame([("b", "mine")], "note_id string, raw string"))
        rows = rows_of(spark, (1, "a", "2"), (2, "b", "theirs"), (3, "c", None), (4, "d", "new"))
        step = getattr(owner, name)

        def stop(*a, step=step, late=late, **k):
            if late:
                step(*a, **k)
            raise OSError("stopped")

        with monkeypatch.context() as m:
            m.setattr(owner, name, stop)
            try:
                applier.take(rows, 0)
            except OSError:
                pass
        again = Applier(spark, applier.root, NoteStore(spark, store.root))
        again.take(rows, 0)
        assert raws(again.store) == want, (name, late)
        assert [r.note_id for r in again.pending().collect()] == ["b"]


def test_a_stream_with_another_writer_and_a_compaction(spark, tmp_path, monkeypatch):
    store, applier = made(spark, tmp_path, {"a": "1"})
    log = SequencedLog(spark, f"file://{tmp_path}/log")
    put = lambda *c: log.append(spark.createDataFrame([(i, 1, json.dumps([{"note_id": k, "raw": v}]).encode()) for i, (k, v) in enumerate(c)], "pos int, ts long, blob binary"))
    run = lambda: applier.run(follow(spark, log.root), f"file://{tmp_path}/cp", once=True).awaitTermination()
    put(("a", "2"), ("b", "1"))
    other = NoteStore(spark, store.root)
    commit = LayeredTable._commit
    raced = []

    def slow(self, *a):
        if not raced and self.root == store.root:
            raced.append(1)
            other.overlay_many(spark.createDataFrame([("z", "z")], "note_id string, raw string"))
        return commit(self, *a)

    monkeypatch.setattr(LayeredTable, "_commit", slow)
    run()
    assert raws(store) == {"a": "1", "z": "z"} and applier.pending().count() == 2  # the other came first; the change waits
    put(("b", "2"), ("c", "1"))
    state = json.dumps([{"note_id": k, "raw": v} for k, v in (("a", "2"), ("b", "2"), ("c", "1"))]).encode()
    log.compact(4, spark.createDataFrame([(0, state)], "idx int, blob binary"))
    put(("c", None))
    run()
    assert raws(store) == {"a": "2", "b": "2", "z": "z"} and applier.pending().count() == 0
