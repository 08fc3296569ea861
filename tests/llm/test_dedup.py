"""Near-duplicate classes against brute force, and the sketch against true weighted similarities."""

import random
import re

import numpy as np
import pytest

from noteloom.llm import graph, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(rows))]


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 30, 80, 200]))]
        for _ in range(r.choice([1, 2, 5, 9])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((k, " ".join(t)))
            k += 1
    # a chain: neighbours are alike, the ends aren't
    chain = [f"c{i}" for i in range(120)]
    for i in range(12):
        rows.append((k, " ".join(chain[i * 3 : i * 3 + 84])))
        k += 1
    return [*rows, (k, None), (k + 1, ""), (k + 2, " \n\t"), (k + 3, "one two"), (k + 4, "one  two"), (k + 5, "one"), (None, "lost text here"), (None, "lost text  here"), (7, "a repeated id with other text")]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, class_id string").repartition(5)
    got = minhash.near_duplicates(df).collect()
    want = sorted(zip([d for d, _ in rows], brute_classes(rows), strict=True), key=str)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == want
    kept = [r.class_id for r in got if r.kept]
    assert len(kept) == len({str(c) for c in kept}) == len({str(c) for _, c in want})


def test_deduplicate_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a b c", 1.5, "x"), (1, "a b  c", 2.5, "y"), (3, "other words", None, "z")], "doc_id long, text string, kept double, __uid string")
    rows = minhash.deduplicate(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, "a b  c", 2.5, "y"), (3, "other words", None, "z")]
    assert minhash.deduplicate(df.where("false")).count() == 0


def test_cross_component_search_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TRIES", 1)  # the leaders then find little; the block search must find the rest
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(zip([d for d, _ in rows], brute_classes(rows), strict=True), key=str)


def test_many_blocks_of_one_bucket_lose_no_link(spark, monkeypatch):
    """A large class and many strays and small classes like it, compared over blocks of four."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "TRIES", 1)
    r = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(90):
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            t[r.randrange(100)] = f"z{r.randrange(50)}"
        rows.append((k, " ".join(t)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.class_id) for x in got) == sorted(zip([d for d, _ in rows], brute_classes(rows), strict=True))


@pytest.mark.parametrize("k", [64, 125])
def test_dart_signatures_estimate_weighted_jaccard(k):
    rng = np.random.default_rng(1)
    h, row, w, truth = [], [], [], []
    for d in range(40):
        e = rng.integers(0, 1 << 62, 150).astype(np.uint64)
        a = rng.uniform(0.05, 6, 150)
        b = a * np.where(rng.random(150) < 0.3, rng.uniform(0, 2, 150), 1)
        h += [e, e]
        row += [np.full(150, 2 * d), np.full(150, 2 * d + 1)]
        w += [a, b]
        truth.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    sig = minhash.dart_signature(np.concatenate(h), np.concatenate(row), np.concatenate(w), 80, k)
    est = (sig[0::2] == sig[1::2]).mean(axis=1)
    assert (sig != 0).all() and abs(est.mean() - np.mean(truth)) < 0.02 and np.abs(est - truth).max() < 0.2


def test_weighted_sets_count_repeats(spark):
    rows = [(1, "a b c d e " * 20), (2, "a b c d e " * 2), (3, "a b c d e " * 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, "count").collect()} == {1: 1, 2: 2, 3: 1}


def test_weighted_classes_equal_brute_force(spark):
    """Texts with repeated passages, by the weighted similarity of the query."""
    import collections

    r = random.Random(8)
    rows = []
    for k in range(30):
        base = [f"v{r.randrange(60)}" for _ in range(r.choice([20, 60]))]
        for _ in range(r.choice([1, 3, 4])):
            t = base * r.choice([1, 2, 2, 3]) + [f"v{r.randrange(60)}" for _ in range(r.choice([0, 1, 3]))]
            rows.append((len(rows), " ".join(t)))
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                parent[find(i)] = find(j)
                links += 1
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), i), i)
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "count").collect()}
    assert links > 10 and got == {i: least[find(i)] for i in range(len(rows))}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), *[(100, 100 + i) for i in range(1, 30)]], "a long, b long")
    got = {r.node: r.comp for r in graph.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(30)}
    assert graph.components(edges.where("false")).count() == 0


def _cells(texts):
    """Rows of the cells of one block of every bucket that holds all ``texts``, each a component of its own."""
    import pyarrow as pa

    from noteloom.llm.common import text_buffers
    from noteloom.llm.textvec import mix64, span_hash, word_spans
    from noteloom.llm.textvec import shingles as hashed

    buf, offs = text_buffers(pa.array(texts))
    starts, ends, row = word_spans(buf, offs)
    h, owner = hashed(span_hash(buf, starts, ends), row, len(texts), 5)
    h, owner, w = minhash._weigh(h, owner, "count")
    small = (mix64(minhash.dart_signature(h, owner, w, len(texts), minhash.BANDS * minhash.ROWS)) >> np.uint64(56)).astype(np.uint8)
    keys = minhash.band_keys(small, minhash.BANDS, minhash.ROWS)
    payload = next(iter(minhash._with_elements("count")(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([x.tobytes() for x in small]), pa.array(texts)], names=["nid", "sig", "text"])])))).to_pylist()
    rows = []
    for key in sorted({int(k) for k in keys.ravel()}):
        inside = [r for r in range(len(texts)) if key in keys[r]]
        rows += [{"key": key, "i": 0, "j": 0, "side": -1, "comp": r} | payload[r] for r in inside if len(inside) > 1]
    names = ["key", "i", "j", "side", "nid", "comp", "size", "sig", "elements"]
    return pa.RecordBatch.from_pylist(rows).select(names), keys


def test_pairs_of_many_shared_buckets_are_compared_in_the_first(monkeypatch):
    """Texts of similarity 0.7 to 0.9 share many buckets; each pair is checked once, and the links are those of brute force."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(40):
        t = list(base)
        for _ in range(1 + k % 3):
            t[r.randrange(120)] = f"z{k}"
        texts.append(" ".join(t + (["again"] * 9 if k % 5 == 0 else [])))
    batch, keys = _cells(texts)
    checked = []
    plain = minhash._alike

    def counted(elements, offs, one, others):
        checked.append(len(others))
        return plain(elements, offs, one, others)

    monkeypatch.setattr(minhash, "_alike", counted)
    sharing = [(i, j) for i in range(40) for j in range(i) if (keys[i] == keys[j]).any()]
    assert sum(int((keys[i] == keys[j]).sum()) for i, j in sharing) > 3 * len(sharing)
    got = {(a, b) for out in minhash._across(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    assert len(got) > 10 and sum(checked) <= len(sharing)
    sets = {x["nid"]: x["elements"] for x in batch.to_pylist()}
    alike = {(j, i) for i, j in sharing if minhash.set_similarity(sets[i], sets[j]) >= minhash.THRESHOLD}
    assert got <= alike

    def classes(links):
        label = list(range(40))
        for _ in range(40):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert classes(got) == classes(alike)
