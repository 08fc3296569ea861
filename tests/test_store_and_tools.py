import pytest
from pyspark.sql import functions as F

from noteloom.errors import EngineError
from noteloom.operators import deltas
from noteloom.operators.store import NoteStore
from noteloom.operators.templates import render, rendered
from noteloom.plans.registry import TOOLS, WRITE_TOOLS, Engine, Plugins, check_manifest
from noteloom.sources import vault
from noteloom.sources.log import Outbox, SequencedLog, complete_snapshots
from noteloom.sources.vectors import BatchEmbedder, HashingEmbedder, VectorCache


def code(call, *a, **k):
    with pytest.raises(EngineError) as err:
        call(*a, **k)
    return err.value.code


def raws(store):
    return {r.note_id: r.raw for r in store.raw().collect()}


def test_propose_commit_revert(spark, tmp_path):
    s = NoteStore(spark, f"file://{tmp_path}/s")
    p = s.propose([{"op": "create", "note_id": "a", "content": "hi"}])
    assert p["diff"] == [{"note_id": "a", "op": "create", "before": None, "after": "hi\n"}] and raws(s) == {}
    assert p["change_id"] == s.propose([{"op": "create", "note_id": "a", "content": "hi"}])["change_id"]
    v1 = s.commit(p["change_id"])["version_id"]
    assert raws(s) == {"a": "hi\n"} and code(s.commit, p["change_id"]) == "UNKNOWN_CHANGE" and code(s.create, "a", "x") == "CONFLICT"
    assert code(s.apply, [{"op": "create", "note_id": "b", "content": "x"}, {"op": "update", "note_id": "zz", "content": "x"}]) == "NOTE_NOT_FOUND" and raws(s) == {"a": "hi\n"}
    v2 = s.update("a", frontmatter={"k": 1})["version_id"]
    assert raws(s) == {"a": "---\nk: 1\n---\nhi\n\n"}  # an update without content keeps the final newline and adds one
    assert [r.asDict() for r in s.get_version(v2).collect()] == [{"note_id": "a", "op": "updated", "before": None, "after": None}]
    full = s.get_version(v2, True, 1).first()
    assert tuple(full.before) == ("hi\n", False) and full.after.truncated
    s.revert(v2)
    assert raws(s) == {"a": "hi\n"}
    s.revert(v1)
    assert raws(s) == {} and code(s.revert, "v_0000000000000000") == "UNKNOWN_VERSION" and code(s.revert, "../x") == "UNKNOWN_VERSION"
    log = s.audit_log().collect()
    assert [r.action for r in log] == ["revert", "revert", "commit", "commit"] and log[3].version_id == v1 and s.audit_log(1).count() == 1
    assert code(s.create, "../up", "x") == "INVALID_INPUT" == code(s.create, "/abs", "x")
    s.vacuum()


def test_read_only(spark, tmp_path):
    s = NoteStore(spark, f"file://{tmp_path}/s", read_only=True)
    p = s.propose([{"op": "create", "note_id": "a", "content": "x"}])
    assert code(s.commit, p["change_id"]) == "PERMISSION_DENIED"


def test_rename_retargets_links(spark, tmp_path):
    s = NoteStore(spark, f"file://{tmp_path}/s")
    files = {"notes/Old": "self [[Old]] end\n", "x": "[[notes/Old|alias]] [[OLD#Part]] [[other]]\n", "y": "[[old#^b]]\n", "other": "none\n"}
    s.load(spark.createDataFrame(list(files.items()), "note_id string, raw string"))
    r = s.rename("notes/Old", "new/place")
    assert r["links_updated_in"] == 2
    now = raws(s)
    assert "notes/Old" not in now and now["new/place"].startswith("self [[new/place]] end") and now["x"].startswith("[[new/place|alias]] [[new/place#Part]] [[other]]") and now["y"].startswith("[[new/place#^b]]")
    s.revert(r["version_id"])
    assert raws(s) == files
    assert code(s.rename, "x", "y") == "CONFLICT" and code(s.rename, "zz", "q") == "NOTE_NOT_FOUND" and code(s.rename, "x", " ") == "INVALID_INPUT"


def test_single_note_changes(spark, tmp_path):
    s = NoteStore(spark, f"file://{tmp_path}/s")
    s.create("a", "text\n- [ ] do it", {"tags": ["t"]})
    s.link("a", "b")
    s.link("a", "b")
    assert raws(s)["a"].count("[[b]]") == 1
    s.tag("a", "u")
    s.tag("a", "u")
    assert "tags:\n- t\n- u\n" in raws(s)["a"]
    s.toggle_task("a", 1, "do it")
    assert "- [x] do it" in raws(s)["a"] and code(s.toggle_task, "a", 0, "do it") == "CONFLICT"
    s.delete("a")
    assert raws(s) == {}


def test_templates(spark):
    assert render("p: {{p}} {{ date }}", {"p": 3, "date": "D"}) == "p: 3 D" and code(render, "{{a}} {{b}} {{time}}", {"a": 1}) == "MISSING_VARS" and code(render, "{{a}}", {"a": []}) == "INVALID_INPUT"
    r = spark.range(1).select(rendered(F.lit("x {{ a }} {{b}}"), F.create_map(F.lit("a"), F.lit("$1\\")))).first()
    assert r[0] == "x $1\\ {{b}}"


def test_vault_and_tools(spark, tmp_path):
    v = tmp_path / "vault"
    for name, text in {
        "a.md": "# A\n[[b]] alpha #t\n- [ ] job due:2026-01-02", ".hidden/_b.md": "beta", "sub/b.md": "---\nstatus: active\n---\nbeta [[a]]", ".noteloom/memory/mem_1.md": "---\nid: mem_1\ntype: user\nkey: k\nsource:\n  origin: o\n  author: human\n  timestamp: t\n---\nlikes tea\n",
        ".noteloom/memory/bad.md": "broken", ".noteloom/templates/daily.md": "---\npriority: {{p}}\n---\n# {{title}}", "note.txt": "no", "sub/.noteloom/x.md": "no",
    }.items():
        (v / name).parent.mkdir(parents=True, exist_ok=True)
        (v / name).write_text(text)
    (v / "bad.md").write_bytes(b"\xff\xfe")
    assert sorted(r.path for r in vault.scan(spark, f"file://{v}").collect()) == [".hidden/_b.md", "a.md", "sub/b.md"]
    assert vault.scan(spark, f"file://{tmp_path}/none").count() == 0
    assert "bad.md" in {r.path for r in vault.scan(spark, f"file://{v}", lossy=True).collect()}
    assert [r.content for r in vault.memories(spark, f"file://{v}").collect()] == ["likes tea"]

    e = Engine(spark, f"file://{tmp_path}/engine")
    e.import_vault(f"file://{v}")
    call = lambda tool, **a: e.dispatch(tool, a)
    ok = lambda tool, **a: call(tool, **a)["data"]
    bad = lambda tool, **a: call(tool, **a)["error"]["code"]
    assert len(TOOLS) == 25 and [t["name"] for t in ok("capabilities")["tools"]] == sorted(TOOLS)
    assert [n["note_id"] for n in ok("list_notes")["notes"]] == [".hidden/_b", "a", "sub/b"]
    assert ok("search", query="alpha", mode="lexical")["hits"][0]["note_id"] == "a" and bad("search") == "INVALID_INPUT"
    assert ok("get_note", note_id="a")["content"] == "- A" and bad("get_note", note_id="zz") == "NOTE_NOT_FOUND"
    assert [n["note_id"] for n in ok("graph_query", **{"from": "a", "relation": "links"})["nodes"]] == ["sub/b"]
    assert ok("properties_query", filters=[{"key": "status", "op": "eq", "value": "active"}])["rows"][0]["properties"] == {"status": "active"}
    assert ok("list_tasks")["tasks"][0]["due"] == "2026-01-02" and ok("list_templates") == {"templates": [{"name": "daily", "vars": ["p", "title"]}]}
    m = ok("remember", type="user", content="drinks tea", source={"origin": "o", "author": "human"})["memory_id"]
    assert {i["memory"]["content"] for i in ok("recall", query="tea")["items"]} == {"likes tea", "drinks tea"}
    assert ok("forget", memory_id=m) == {"removed": True} and ok("forget", memory_id=m) == {"removed": False}
    v1 = ok("create_from_template", template="daily", note_id="d1", vars={"p": 3, "title": "Day"})["version_id"]
    assert ok("get_version", version_id=v1)["notes"][0]["op"] == "created" and ok("get_note", note_id="d1", format="frontmatter_only")["content"] == "priority: 3"
    assert bad("create_from_template", template="../x", note_id="q") == "TEMPLATE_NOT_FOUND" and bad("create_from_template", template="daily", note_id="q") == "MISSING_VARS"
    change = ok("propose_changes", ops=[{"op": "delete", "note_id": "d1"}])["change_id"]
    assert "version_id" in ok("commit_changes", change_id=change) and ok("audit_log", limit=1)["entries"][0]["action"] == "commit"
    assert bad("nothing") == "INVALID_INPUT" and e.dispatch("search", {"query": "x"}, {"recall"})["error"]["code"] == "PERMISSION_DENIED"
    assert e.dispatch("search", ["x"])["error"]["code"] == "INVALID_INPUT"
    ro = Engine(spark, f"file://{tmp_path}/engine", read_only=True)
    assert {ro.dispatch(t, {})["error"]["code"] for t in WRITE_TOOLS} == {"PERMISSION_DENIED"}

    plugins, seen = Plugins(e), []
    plugins.register({"name": "p", "entry": "p.py", "tools": ["list_notes"], "hooks": ["note_saved"]}, lambda c, x: seen.append(x) or {"n": len(c("list_notes")["data"]["notes"]), "denied": c("forget", {})["error"]["code"]}, trusted=True)
    assert plugins.run("p", {})["data"] == {"n": 3, "denied": "PERMISSION_DENIED"}
    ok("create_note", note_id="n1", content="x")
    assert seen[-1] == {"hook": "note_saved", "notes": ["n1"]}
    plugins.register({"name": "t", "entry": "t.py"}, lambda c, x: 1 / 0)
    plugins.register({"name": "j", "entry": "j.py"}, lambda c, x: object())
    assert plugins.run("t", {})["error"]["code"] == "PLUGIN_TRAP" and plugins.run("j", {})["error"]["code"] == "PLUGIN_ABI"
    for m in ({"name": "x", "entry": "../x"}, {"name": "x", "entry": "x", "tools": ["zz"]}, {"name": "x", "entry": "x", "hooks": ["zz"]}):
        assert code(check_manifest, m, False) == "INVALID_MANIFEST"
    assert code(check_manifest, {"name": "x", "entry": "x", "tools": ["link"]}, True) == "INVALID_MANIFEST"


def test_sequenced_log(spark, tmp_path):
    log = SequencedLog(spark, f"file://{tmp_path}/log", quota=100)
    rows = lambda n: spark.createDataFrame([(i, 5, bytes([i] * 10)) for i in range(n)], "pos int, ts long, blob binary")
    assert log.append(rows(3)) == 3 and log.append(rows(0)) == 3 and log.append(rows(2)) == 5
    assert [r.seq for r in log.read_since(2).collect()] == [3, 4, 5]
    parts = spark.createDataFrame([(0, b"s")], "idx int, blob binary")
    assert code(log.compact, 9, parts) == "INVALID_INPUT"
    log.compact(3, parts)
    assert code(log.compact, 3, parts) == "INVALID_INPUT" and log.used_bytes() == 20
    snap, tail = log.resume(1)
    assert snap.count() == 1 and [r.seq for r in tail.collect()] == [4, 5]
    assert log.resume(4)[0] is None and log.append(rows(9)) == 14 and code(log.append, rows(1)) == "IO_ERROR"
    log.stage_part(12, 0, b"old")
    log.stage_part(12, 0, b"p0")
    assert code(log.stage_part, 12, 2, b"x") == "INVALID_INPUT" == code(log.commit_staged, 12, 2) and log.snapshot_seq() == 3
    log.stage_part(12, 1, b"p1")
    log.commit_staged(12, 2)
    assert [bytes(r.blob) for r in log.resume(0)[0].collect()] == [b"p0", b"p1"] and [r.seq for r in log.resume(0)[1].collect()] == [13, 14]
    sets = spark.createDataFrame([(7, 0, 2), (7, 1, 2), (7, 1, 2), (8, 0, 2), (9, 2, 2), (9, 1, 2)], "upto long, idx int, of int")
    assert [r.upto for r in complete_snapshots(sets).collect()] == [7]


def test_outbox(spark, tmp_path):
    box = Outbox(spark, f"file://{tmp_path}/box")
    put = lambda *p: box.put(spark.createDataFrame(list(p), "id string, payload string").coalesce(1))
    assert box.pending().count() == 0
    put(("b", "1"), ("a", "2"))
    put(("c", "3"), ("a", "2"))
    assert [r.id for r in box.pending().collect()] == ["b", "a", "c"]
    box.ack(spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in box.pending().collect()] == ["a", "c"]


def test_deltas(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, hash string")
    was = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "key string, hash string")
    assert {tuple(r) for r in deltas.scan_delta(now, was).collect()} == {("b", "modified"), ("c", "created"), ("d", "deleted")}
    docs = spark.createDataFrame([("x", "p", 3), ("x", "q", 1), ("y", "p", 2), ("z", "p", 1)], "item string, client string, clock int")
    tombs = spark.createDataFrame([("x", "p", 3), ("x", "q", 2), ("y", "p", 1)], "item string, client string, clock int")
    assert {tuple(r) for r in deltas.covered(docs, tombs).collect()} == {("x", True), ("y", False), ("z", False)}
    ev = spark.createDataFrame([("v", 1, "updated", "active", 10, 5), ("v", 2, "updated", "canceled", 9, 5), ("w", 3, "updated", "active", 1, 5), ("w", 4, "sub.deleted", "active", 2, 5)], "vault string, event_id int, type string, status string, created long, quota_bytes long")
    assert [r.vault for r in deltas.entitlement_fold(ev).collect()] == ["v"]
    q = deltas.quota_check(spark.createDataFrame([("v", 5), ("u", 5)], "vault string, used long"), ev)
    assert {(r.vault, r.accepts) for r in q.collect()} >= {("u", True), ("v", False)}
    p = spark.createDataFrame([("d", 5, False), ("d", 3, True), ("e", 5, True)], "device string, ts long, gone boolean")
    assert [r.device for r in deltas.presence_state(p).collect()] == ["d"] and deltas.presence_alive(p, 50_006).count() == 0


def test_vectors(spark, tmp_path):
    texts = spark.createDataFrame([("a", "migration"), ("b", ""), ("c", "migration"), ("d", None)], "id string, text string")
    rows = {r.id: r.vector for r in HashingEmbedder().embed(texts).collect()}
    assert len(rows["a"]) == 2048 and abs(sum(x * x for x in rows["a"]) - 1) < 1e-9 and not any(rows["b"]) and rows["a"] == rows["c"]
    calls = spark.sparkContext.accumulator(0)

    def model(batch):
        calls.add(len(batch))
        if "boom" in batch:
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in batch]

    cache = VectorCache(spark, f"file://{tmp_path}/cache", BatchEmbedder(2, model, 1))
    assert {r.id: r.vector for r in cache.embed(texts).collect()} == {"a": [9, 1], "c": [9, 1], "b": [0, 1], "d": [0, 1]}
    n = calls.value
    cache.embed(texts).collect()
    assert calls.value == n == 2
    assert [r.vector for r in BatchEmbedder(2, model).embed(spark.createDataFrame([("x", "boom")], "id string, text string")).collect()] == [[0, 0]]


def test_paths_are_taken_as_they_are(spark, tmp_path):
    names = ["a b.md", "a%20b.md", "c#d.md", "e[1].md", "f%.md", "{g}.md", "h?x.md", "i*.md", "é ü.md", "sub dir/_x.md"]
    for n in names:
        (tmp_path / "v" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / n).write_text(n)
    assert {r.path: r.raw for r in vault.scan(spark, f"file://{tmp_path}/v").collect()} == {n: n for n in names}


def test_links_may_hold_an_opening_bracket(spark):
    from noteloom.functions.parsing import links

    found = spark.createDataFrame([("see [[a [b]] and [[c|d [e]] [[]] [[f]",)], "t string").select(links("t").alias("l")).first().l
    assert [(x.target, x.alias) for x in found] == [("a [b", None), ("c", "d [e")]


def test_a_stop_between_any_two_steps_leaves_the_store_whole(spark, tmp_path, monkeypatch):
    """The steps of a commit are files written, records created and folders removed; each is made to fail in turn."""
    from noteloom.sources.layers import LayeredTable
    from noteloom.sources.places import Files

    s = NoteStore(spark, f"file://{tmp_path}/s")
    v1 = s.create("a", "one")["version_id"]
    before, n, audit = raws(s), s.generation(), s.audit_log().count()

    def stop(*_, **__):
        raise OSError("stopped")

    for owner, name in ((LayeredTable, "_write"), (LayeredTable, "_commit"), (Files, "create"), (Files, "_rename")):
        with monkeypatch.context() as m:
            m.setattr(owner, name, stop)
            with pytest.raises(OSError):
                s.update("a", content="two")
        again = NoteStore(spark, s.root)
        assert raws(again) == before and again.generation() == n and again.audit_log().count() == audit
    lost = [d.name.split("-")[0] for d in (tmp_path / "s" / "history").iterdir() if not d.name.startswith(v1)]
    assert lost and all(code(s.history, v) == "UNKNOWN_VERSION" for v in lost)
    s.update("a", content="two")
    assert raws(s) == {"a": "two\n"} and s.history(v1).count() == 1


def test_two_writers_conflict_and_layers_are_merged(spark, tmp_path, monkeypatch):
    from noteloom.sources import layers

    monkeypatch.setattr(layers, "LAYERS", 3)
    a, b = (NoteStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.load(spark.createDataFrame([(f"n{i}", f"t{i}") for i in range(5)], "note_id string, raw string"))
    want = {f"n{i}": f"t{i}" for i in range(5)}
    for i in range(5):
        a.apply([{"op": "setraw", "note_id": f"n{i}", "raw": None if i % 2 else f"x{i}"}])
        want = {k: v for k, v in (want | {f"n{i}": f"x{i}"}).items() if k != f"n{i}" or not i % 2}
        assert raws(b) == want and len(a.table.newest()["layers"]) <= 3
    stale = b.table.newest()
    a.create("z", "z")
    monkeypatch.setattr(b.table, "newest", lambda: stale)
    assert code(b.create, "y", "y") == "CONFLICT" and raws(a) == want | {"z": "z\n"}
    a.vacuum()
    assert raws(a) == want | {"z": "z\n"}


def test_log_rows_of_failed_appends_are_never_seen(spark, tmp_path, monkeypatch):
    from noteloom.sources.places import Files
    from noteloom.streaming.sync import apply_batches, resume_tail

    log = SequencedLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([(i, 1, bytes([i])) for i in range(40)], "pos int, ts long, blob binary").repartition(3)
    with monkeypatch.context() as m:
        m.setattr(Files, "rename", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            log.append(rows)
    assert log.last_seq() == 0 and log.read_since(0).count() == 0
    assert log.append(rows) == 40 and [(r.seq, bytes(r.blob)) for r in log.read_since(0).collect()] == [(i + 1, bytes([i])) for i in range(40)]
    assert log.append(rows) == 80
    log.compact(40, spark.createDataFrame([(0, b"s")], "idx int, blob binary"))
    parts, stream = resume_tail(log, 7)
    seen = []
    q = apply_batches(stream, lambda df, b: seen.extend(r.seq for r in df.collect()), f"file://{tmp_path}/cp", once=True)
    assert q.awaitTermination(90) and parts.count() == 1 and seen == list(range(41, 81))
    assert resume_tail(log, 50)[0] is None


def test_plugins_have_limits(spark, tmp_path, monkeypatch):
    from noteloom.plans import registry

    monkeypatch.setattr(registry, "PLUGIN_CALLS", 3)
    monkeypatch.setattr(registry, "PLUGIN_BYTES", 100)
    plugins = Plugins(Engine(spark, f"file://{tmp_path}/e"))
    plugins.register({"name": "loop", "entry": "l.py", "tools": ["capabilities"]}, lambda c, x: [c("capabilities") for _ in range(4)])
    plugins.register({"name": "big", "entry": "b.py"}, lambda c, x: "x" * 20_000)
    assert plugins.run("loop", {})["error"]["code"] == "PLUGIN_TRAP" and plugins.run("big", {})["error"]["code"] == "PLUGIN_ABI"


OPS = "seq long, op string, note_id string, content string, frontmatter string, raw string"


def test_a_change_made_between_check_and_commit_is_a_conflict(spark, tmp_path, monkeypatch):
    """Another writer commits after the first has read the state that its ops are checked against."""
    from noteloom.operators import store as module

    a, b = (NoteStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.create("n", "one")
    plan = module.planned

    def slow(ops, notes):
        monkeypatch.setattr(module, "planned", plan)
        b.update("n", content="theirs")
        return plan(ops, notes)

    monkeypatch.setattr(module, "planned", slow)
    assert code(a.update, "n", content="mine") == "CONFLICT" and raws(a) == {"n": "theirs\n"}


def test_bulk_changes(spark, tmp_path):
    s = NoteStore(spark, f"file://{tmp_path}/s")
    s.load(spark.range(3000).select(F.concat(F.lit("n"), "id").alias("note_id"), F.lit("---\nk: 1\n---\nold").alias("raw")))
    ops = spark.range(2000).select("id", F.when(F.col("id") < 1500, "update").otherwise("delete").alias("op"), F.concat(F.lit("n"), "id").alias("note_id"), F.lit("new").alias("content"), F.lit(None).cast("string").alias("f"), F.lit(None).cast("string").alias("r")).toDF(*[c.split()[0] for c in OPS.split(", ")])
    wrong = spark.createDataFrame([(9000, "create", "n1", "x", None, None), (9001, "update", "zz", "x", None, None), (9002, "delete", "../up", None, None, None), (9003, "paint", "n2", None, None, None)], OPS)
    change, plan = s.propose_many(ops.union(wrong))
    assert sorted((r.seq, r.error) for r in plan.where("error IS NOT NULL").collect()) == [(9000, "CONFLICT"), (9001, "NOTE_NOT_FOUND"), (9002, "INVALID_INPUT"), (9003, "INVALID_INPUT")]
    assert code(s.commit, change) == "CONFLICT" and s.raw().count() == 3000 and not s.files.names("history")
    assert s.propose_many(ops.orderBy(F.desc("seq")))[0] == s.propose_many(ops)[0] != change
    v = s.apply_many(ops)["version_id"]
    assert {(r.raw, r.n) for r in s.raw().groupBy("raw").agg(F.count("*").alias("n")).collect()} == {("---\nk: 1\n---\nnew\n", 1500), ("---\nk: 1\n---\nold", 1000)}
    entry = s.audit_log(1).first()
    assert entry.n_notes == 2000 and entry.notes is None and s.history(v).where("note_id = 'n1600'").first().op == "delete"
    s.revert(v)
    assert s.raw().where("raw LIKE '%old'").count() == 3000


def jobs_of(spark, call):
    name = f"g{id(call)}"
    spark.sparkContext.setJobGroup(name, name)
    call()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_renames_and_changes_take_as_many_jobs_for_any_size(spark, tmp_path):
    """By the count of Spark jobs."""
    taken = []
    for n in (3, 60):
        s = NoteStore(spark, f"file://{tmp_path}/s{n}")
        s.load(spark.createDataFrame([("hub", "h"), *[(f"n{i}", f"[[hub]] {i}") for i in range(n)]], "note_id string, raw string").coalesce(1))
        taken.append(jobs_of(spark, lambda s=s: s.rename("hub", "x/centre")))
        assert {r.raw.strip() for r in s.raw().where("note_id <> 'x/centre'").collect()} == {f"[[x/centre]] {i}" for i in range(n)}
    assert abs(taken[1] - taken[0]) <= 4 and max(taken) < 60


def test_an_edit_updates_the_search_index_by_its_own_notes(spark, tmp_path, monkeypatch):
    from noteloom.operators.index import StoredIndex

    e = Engine(spark, f"file://{tmp_path}/e")
    e.store.load(spark.createDataFrame([(f"n{i}", f"word{i} shared") for i in range(30)], "note_id string, raw string"))
    hits = lambda q: {h["note_id"] for h in e.dispatch("search", {"query": q, "mode": "lexical"})["data"]["hits"]}
    assert hits("word3") == {"n3"} and len(hits("shared")) == 30
    monkeypatch.setattr(StoredIndex, "build", lambda *a: pytest.fail("built anew"))
    indexed = []
    layer = StoredIndex._layer
    monkeypatch.setattr(StoredIndex, "_layer", lambda self, notes, gone: indexed.append(notes.count()) or layer(self, notes, gone))
    e.dispatch("update_note", {"note_id": "n3", "content": "word99"})
    e.dispatch("delete_note", {"note_id": "n4"})
    assert hits("word3") == set() and hits("word99") == {"n3"} and len(hits("shared")) == 28
    v = e.dispatch("create_note", {"note_id": "m", "content": "shared too"})["data"]["version_id"]
    assert "m" in hits("shared")
    e.dispatch("revert", {"version_id": v})
    assert "m" not in hits("shared") and indexed == [1, 1, 0]
    assert {h["note_id"] for h in e.dispatch("search", {"query": "word5", "top_k": 1})["data"]["hits"]} == {"n5"}


def test_plugins_end_within_their_bounds_and_the_engine_lives(spark, tmp_path):
    import time

    plugins = Plugins(Engine(spark, f"file://{tmp_path}/e"), cpu_s=1, memory=128 << 20, wait_s=6)

    def endless(call, given):
        while True:
            pass

    def asleep(call, given):
        time.sleep(600)

    def large(call, given):
        return len(bytearray(1 << 30))

    def printing(call, given):
        print("not a message")
        return {"tools": len(call("capabilities")["data"]["tools"]), "denied": call("forget", {"memory_id": "x"})["error"]["code"], "given": given}

    for f in (endless, asleep, large, printing):
        plugins.register({"name": f.__name__, "entry": "p.py", "tools": ["capabilities"]}, f)
    for name in ("endless", "asleep", "large"):
        start = time.monotonic()
        assert plugins.run(name, {})["error"]["code"] == "PLUGIN_TRAP" and time.monotonic() - start < 30, name
    assert plugins.run("printing", {"a": 1})["data"] == {"tools": len(TOOLS), "denied": "PERMISSION_DENIED", "given": {"a": 1}}
