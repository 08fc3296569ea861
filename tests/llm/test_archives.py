"""Archives, the manifest and the trie against brute force, a round trip and planted damage."""

import glob
import gzip
import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from noteloom.llm import common, merkle, prefix_trie, queries, warc

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(value):
    return zlib.crc32(str(value).encode())


@pytest.mark.parametrize("name", ["op11_warc_archives", "op12_merkle_manifest", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)


# --- places ---


def test_places_follow_each_other_across_partitions(spark):
    rows = [("a", None if i == 5 else (i * 7919) % 1000, i % 3) for i in range(1000)] + [("b", 1, 0)] * 3 + [("c", 2, 0)]
    df = common.staged(spark.createDataFrame(rows, "g string, k int, x int").repartition(7), "t")
    got = sorted(common.placed(df, "g", ["k", "x"], "placed").collect(), key=lambda r: (r.g, r["__pos"]))
    assert [(r.g, r["__pos"], r["__n"]) for r in got] == [("a", i, 1000) for i in range(1000)] + [("b", i, 3) for i in range(3)] + [("c", 0, 1)]
    mine = [((r.k is not None, r.k or 0), r.x) for r in got if r.g == "a"]
    assert mine == sorted(mine)
    assert common.placed(df.where("false"), "g", ["k"], "placed").count() == 0


# --- manifest ---


def brute_manifest(rows, tampered, arity=16):
    """All from the definition: rows are (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(enc, r)))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([sha("".join(now[i : i + arity])) for i in range(0, len(now), arity)])
        return levels

    def sides(levels, at):
        for level in levels[:-1]:
            lo = at - at % arity
            yield "".join(level[lo:at]), "".join(level[at + 1 : lo + arity])
            at //= arity

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    outer = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*sides(trees[s], i), *sides(outer, k)]
            now = leaf(r)
            if tampered(r) and r[4] is not None:
                now = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for lo, hi in path:
                now = sha(lo + now + hi)
            root = outer[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, sha("".join(lo + hi for lo, hi in path)), now, now == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(spark, rows, **more):
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    return sorted(map(tuple, merkle.manifest(df.withColumns({k: F.lit(v) for k, v in more.items()}), merkle.marked(F.col("doc_id"))).collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else "hot", "de", i, f"Text {i} É ÀB") for i in range(700)] + [(None, None, None, None, None), (None, "s1", "x", 1, "AB"), (-5, "s1", None, None, ""), (3, "s0", "en", 2, "B"), (3, "s0", "en", 2, "B"), (3, "s0", "en", 2, "A"), (9, "", "", 0, "Zz"), (12, "é", "", 0, "X" * 300_000)]
    want = brute_manifest(rows, lambda r: r[0] is not None and crc(r[0]) % 5 == 0)
    assert manifest_rows(spark, rows, grp="clash", h="clash", pos=1) == want
    assert {r[6] for r in want} == {True, False}


def test_sources_of_any_size_and_many_sources(spark, monkeypatch):
    """Sizes about the powers of the arity; with blocks of 16 nodes the layers are many."""
    for levels in (1, 3):
        monkeypatch.setattr(merkle, "LEVELS", levels)
        monkeypatch.setattr(merkle, "BLOCK", 16**levels)
        monkeypatch.setattr(merkle, "CHUNK", 64 if levels == 1 else 16 * 4096)
        rows = [(i, f"n{n}", "l", 1, f"A{i}") for n in ((1, 2, 15, 16, 17, 255, 256, 257) if levels == 1 else (1, 16, 257)) for i in range(n)] + [(i, f"many{i}", "l", 1, "T") for i in range(30)]
        if levels == 1:
            steps = F.when(F.col("n") <= 1, 0).otherwise(1)
            monkeypatch.setattr(merkle, "_rows", lambda nodes, *more, s=steps: nodes.select("grp", F.expr("pos div 16").alias("block"), (F.col("pos") % 16).alias("i"), "n", s.cast("long").alias("steps"), "h", *more))
        assert manifest_rows(spark, rows) == brute_manifest(rows, lambda r: crc(r[0]) % 5 == 0)
        monkeypatch.undo()


def test_manifest_of_nothing_and_of_one(spark):
    assert manifest_rows(spark, []) == []
    (one,) = manifest_rows(spark, [(4, "s", "l", 1, "text")])
    assert one[1] == one[2] == one[3] == one[5] and one[4] == sha("") and one[6]


def test_untampered_rows_verify(spark):
    df = spark.createDataFrame([(i, "s", "l", 1, "Text") for i in range(20)], DOCS)
    assert all(r.verified for r in merkle.manifest(df).collect())


# --- WARC ---

PAGES = "page_id long, url string, html string"
BIG, LONG = "<p>equal</p>" * 100, "<p>é long</p>" * 200_000


def some_pages():
    rows = [(i, f"http://x/{i}", BIG) for i in range(1, 40)] + [(50, "http://y/ a\r\nX: 1", "<p>small</p>"), (51, None, "<p>small</p>"), (None, "http://z", None), (52, "u", ""), (7, "again", BIG + "é"), (7, "again", BIG + "é")]
    return [*rows, (60, "long", LONG), (61, "long", LONG), (None, "n", "x" * 1500), (None, "n", "x" * 1500), (70, "n", "y" * 999), (71, "n", "y" * 999), (72, "n", "z" * 1000), (73, "n", "z" * 1000)]


def brute_archives(rows):
    out, groups = [], {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    for data, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            again = len(data) >= 1000 and k < len(ids) - 1
            out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", ids[-1] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(some_pages(), PAGES).repartition(5).withColumns({"sha1": F.lit("clash"), "uid": F.lit(1), "n": F.lit(0)})
    where = common.new_dir(spark, "warc")
    assert sorted(map(tuple, warc.round_trip(df, where).collect()), key=str) == brute_archives(some_pages())
    back = warc.read_archives(spark, where).where("record_type = 'response'").collect()
    held = sorted(bytes(r.payload) for r in back)
    assert sorted({(h or "").encode() for _, _, h in some_pages()}) == sorted(set(held))
    assert warc.round_trip(df.where("false"), common.new_dir(spark, "warc")).count() == 0
    for path in glob.glob(f"{where.removeprefix('file://')}/*.gz"):  # any gzip reader can read them
        with gzip.open(path) as f:
            assert f.read().startswith(b"WARC/1.1\r\n")


def test_header_lines_cannot_be_forged(spark):
    where = common.new_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "http://y/\r\nWARC-Type: x\r\n\r\n", "a")], PAGES), where)
    (r,) = warc.read_archives(spark, where).where("record_type <> 'warcinfo'").collect()
    assert r.target_uri == "http://y/%0D%0AWARC-Type:%20x%0D%0A%0D%0A" and bytes(r.payload) == b"a"


def test_filters_are_pushed_and_unwanted_payloads_are_not_inflated(spark):
    where = common.new_dir(spark, "warc")
    text = lambda i: "".join(sha(f"{i} {k}") for k in range(200))
    warc.write_archives(spark.createDataFrame([(i, f"http://h{i % 2}/{i}", text(i)) for i in range(6)], PAGES).coalesce(1), where)
    (path,) = glob.glob(f"{where.removeprefix('file://')}/*.gz")
    index = {r.record_id: r.offset for r in warc.read_archives(spark, where, payload=False).collect()}
    spoilt = next(at for name, at in index.items() if name.startswith("<urn:page:3:"))
    data = bytearray(open(path, "rb").read())
    length = warc._length_of(_Held(bytes(data)), spoilt)[0]
    data[spoilt + length - 40 : spoilt + length - 8] = b"\xff" * 32  # the end of a payload's compressed form
    open(path, "wb").write(data)
    found = warc.read_archives(spark, where)
    with pytest.raises(PythonException):
        found.collect()
    rest = found.where("target_uri LIKE 'http://h0/%' AND record_type = 'response' AND payload_length > 5")
    assert len(rest.collect()) == 3
    assert warc.read_archives(spark, where, payload=False).count() == 7
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter true" not in plan


class _Held:
    def __init__(self, data):
        self.data = data

    def get(self, at, n):
        return self.data[at : at + n]


@pytest.mark.parametrize(
    ("condition", "n"),
    [("record_type IN ('response', 'warcinfo')", 3), ("record_type <> 'response'", 2), ("refers_to IS NULL", 3), ("refers_to IS NOT NULL", 1), ("payload_length < 5", 1), ("payload_length >= 5", 2), ("content_length + 1 < 0", 0), ("target_uri <=> 'http://b'", 1), ("target_uri LIKE '%é%'", 0), ("record_type = 'revisit' OR payload_length < 5", 2), ("payload_sha1 = sha1('abc')", 1)],
)
def test_filters_mean_what_spark_means(spark, condition, n):
    where = common.new_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "http://a", "x" * 2000), (2, "http://b", "x" * 2000), (3, "http://c", "abc")], PAGES).coalesce(1), where)
    assert len(warc.read_archives(spark, where).where(condition).collect()) == n


def test_ranges_read_each_record_once(spark):
    where = common.new_dir(spark, "warc")
    n = 300
    warc.write_archives(spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(n)], PAGES).coalesce(1), where)
    for split in (1, 97, 1000, 1 << 20):
        found = [] if split == 1 else [r.record_id for r in warc.read_archives(spark, where, split_bytes=split, payload=False).where("record_type = 'response'").collect()]
        if split > 1:
            assert len(found) == len(set(found)) == n


def test_foreign_archives(spark, tmp_path):
    """Members without lengths, uncompressed files, records that aren't HTTP, archives within archives."""
    record = lambda kind, block, ctype="text/plain": warc._record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x:{len(block)}>"), ("WARC-Date", "d"), ("Content-Type", ctype)], block)
    inner = gzip.compress(record("resource", b"inner"))
    blocks = [b"", b"plain text", inner, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", os.urandom(200_000)]
    kinds = ["text/plain"] * 3 + ["application/http; msgtype=response", "application/octet-stream"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record("resource", b, c)) for b, c in zip(blocks, kinds, strict=True)))
    (tmp_path / "b.warc").write_bytes(b"".join(record("resource", b, c) for b, c in zip(blocks, kinds, strict=True)))
    (tmp_path / "ignored.txt").write_text("x")
    for split in (5000, 1 << 20):
        got = warc.read_archives(spark, f"file://{tmp_path}", split_bytes=split).collect()
        for name in ("a.warc.gz", "b.warc"):
            assert sorted(bytes(r.payload) for r in got if r.path == name) == sorted([b"", b"plain text", inner, b"body", blocks[4]])
    assert warc.read_archives(spark, f"file://{tmp_path}", payload=False).where("content_length > 1000").count() == 2
    (tmp_path / "c.warc").write_bytes(b"no record")
    with pytest.raises(PythonException):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


# --- trie ---

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = (role or "", text or "")
            own.setdefault(c, []).append(((turn is not None, turn or 0), sha(f"{len(key[0].encode())}:{key[0]}{key[1]}"), key))
    own = {c: [k for _, _, k in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = crc(c) % 4
        made[c] = own.get(c - c % 20 if c >= 0 else c + (-c) % 20, [])[:h] + t[h:]
    nodes = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), set()).add(c)
    out = []
    words = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w])
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * words(p[-1][1]) for p in below if p)
        ended = sorted(c for c in members if len(made[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, sha(",".join(map(str, ended)))))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, TURNS).repartition(4).withColumns({"conv": F.lit(1), "depth": F.lit("clash"), "key": F.lit(0)})
    found = prefix_trie.trie(df)
    assert tuple(found.columns) == prefix_trie.OUTPUT
    return sorted(map(tuple, found.collect()), key=str)


def test_trie_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for c in range(-45, 130):
        if c % 11 == 4:
            continue
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no or so", "what\tof\x0b it é"])))
    rows += [(200, None, None, None), (200, 1, "user", None), (201, None, None, None), (202, 3, "", ""), (202, 3, "", ""), (None, 1, "user", "lost"), (9, 0, "user", "no or so " * 50_000), (300, 2, "a", "tie"), (300, 2, "b", "tie")]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_long_equal_conversations_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, t, "u", f"turn {t}") for c in range(40) for t in range(20)] + [(1000 + 20 * c, 0, "u", "only") for c in range(60)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_small_tries(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "u", "x")]) == []
    assert trie_rows(spark, [(5, 1, "u", "x y")]) == brute_trie([(5, 1, "u", "x y")])
    gone = next(c for c in range(1, 20) if crc(c) % 4 > 0)
    assert trie_rows(spark, [(gone, 1, "u", "x")]) == [(gone, 0, None, 1, 0, 1, 0, sha(str(gone)))]


def test_bands_of_depths(spark):
    rows = spark.range(1, 300).select("id", prefix_trie._band(F.col("id")).alias("b")).collect()
    assert all(r.b == prefix_trie._band(r.id) for r in rows) and [prefix_trie._band(d) for d in (1, 16, 17, 32, 33)] == [1, 16, 17, 17, 18]
