import os

from pyspark.sql import functions as F

from noteloom.sources import vault


def test_listing_by_rounds_and_changed_files_only(spark, tmp_path):
    root = tmp_path / "v"
    for name in ("a.md", "deep/er/and/deeper/b.md", ".dot/_u.md", "odd {x} [1]%20?/é ü.md", ".noteloom/memory/m.md", "x/.noteloom/y.md", "n.txt", "deep/c.md", "deep/d.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    want = {"a.md", "deep/er/and/deeper/b.md", ".dot/_u.md", "odd {x} [1]%20?/é ü.md", "deep/c.md", "deep/d.md"}
    found = vault.scan(spark, f"file://{root}")
    assert {r.path: r.raw for r in found.collect()} == {n: n for n in want} and {r["size"] for r in found.where("path = 'a.md'").collect()} == {4}
    shadow = spark.createDataFrame([tuple(r) for r in found.select("path", F.sha2("raw", 256), "mtime_ms", "size").collect()], "path string, hash string, mtime_ms long, size long")
    (root / "a.md").write_text("longer now")
    os.utime(root / "deep/c.md", (1, 1))  # touched, not changed
    (root / "deep/d.md").unlink()
    (root / "new").mkdir()
    (root / "new/e.md").write_text("e")
    (root / "bad.md").write_bytes(b"\xff")
    delta, fresh = vault.scan_changes(spark, f"file://{root}", shadow)
    assert {tuple(r) for r in delta.collect()} == {("a.md", "modified"), ("deep/d.md", "deleted"), ("new/e.md", "created")}
    assert {r.path for r in fresh.collect()} == {"a.md", "deep/c.md", "new/e.md"}
    assert "bad.md" in {r.path for r in vault.scan_changes(spark, f"file://{root}", shadow, lossy=True)[1].collect()}
    assert vault.listing(spark, f"file://{tmp_path}/none").count() == 0


def test_a_store_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    (tmp_path / "v/sub").mkdir(parents=True)
    (tmp_path / "v/sub/a b.md").write_text("x")
    (tmp_path / "v/b.md").write_text("y")
    monkeypatch.setattr(vault, "_known", lambda root: False)
    assert {(r.path, r.raw, r["size"]) for r in vault.scan(spark, f"file://{tmp_path}/v").collect()} == {("sub/a b.md", "x", 1), ("b.md", "y", 1)}


def test_written_files(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    rows = lambda *r: spark.createDataFrame(list(r), "path string, raw string")
    assert vault.write_files(rows(("a/b.md", "one"), ("c.md", "two")), root) == 2
    vault.write_files(rows(("a/b.md", "three"), ("c.md", None), ("never.md", None)), root)
    assert {r.path: r.raw for r in vault.scan(spark, root).collect()} == {"a/b.md": "three"} and sorted(os.listdir(tmp_path / "v/a")) == ["b.md"]
