import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteloom.errors import EngineError
from noteloom.functions import parsing
from noteloom.functions.dynamic import Filter
from noteloom.operators import evals, graph, memory, notes as views, properties, suggest
from noteloom.operators.budget import greedy
from noteloom.operators.packing import pack
from noteloom.operators.search import SearchIndex, dense_top_k


def parsed(spark, files):
    return parsing.parse_notes(spark.createDataFrame(list(files.items()), "path string, raw string"))


# fixed values: the published retrieval scenarios, whose scores are known
SCENARIOS = [
    {
        "name": "launch deadline", "query": "launch deadline", "relevant": ["launch"],
        "notes": {"launch": "# Launch\nThe product launch deadline is March 2026.", "recipes": "# Recipes\nHow to bake sourdough bread at home.", "budget": "# Budget\nQuarterly financial planning and spreadsheets."},
    },
    {
        "name": "kubernetes cluster", "query": "kubernetes cluster", "relevant": ["infra/k8s", "infra/deploy"],
        "notes": {"infra/k8s": "Kubernetes cluster autoscaling notes.", "infra/deploy": "Deploying services to the kubernetes cluster.", "marketing": "Social media campaign ideas for Q2."},
    },
    {
        "name": "database migration", "query": "database migration", "relevant": ["target"],
        "notes": {"target": "Migration plan: migrate the database schema safely.", "distractor": "Bird migration patterns in spring.", "other": "Coffee brewing methods and grind sizes."},
    },
    {
        "name": "alpha signal", "query": "alpha signal", "relevant": ["a", "b"], "token_budget": 120,
        "notes": {"a": "alpha alpha alpha signal signal signal", "b": "alpha signal " + "noise " * 40, "c": "entirely unrelated gardening content"},
    },
]
EXPECTED = {"launch deadline": (1, 1, 1, 1, 13), "kubernetes cluster": (1, 1, 1, 1, 22), "database migration": (0.5, 1, 2 / 3, 0.5909, 22), "alpha signal": (1, 1, 1, 1, 70)}


def test_eval_scenarios(spark):
    def retriever(notes, s):
        heading = F.regexp_extract("content", r"^# (.*)", 1)
        titled = notes.withColumn("title", F.when(heading != "", heading).otherwise(F.col("title")))
        return SearchIndex(titled).search(s["query"], token_budget=s.get("token_budget"), top_k=s.get("top_k"))

    out = evals.run_suite(spark, SCENARIOS, retriever)
    got = {r.name: (r.precision, r.recall, r.f1, r.efficiency, r.tokens) for r in out.collect()}
    assert set(got) == set(EXPECTED)
    for name, want in EXPECTED.items():
        assert got[name] == pytest.approx(want, abs=1e-3)
    mean = evals.averages(out, ["precision", "recall", "f1", "efficiency"]).first()
    assert tuple(mean) == pytest.approx((0.875, 1.0, 0.9167, 0.8977), abs=1e-3)
    index = SearchIndex(spark.createDataFrame([(k, k.rsplit("/")[-1], v) for k, v in SCENARIOS[1]["notes"].items()], "id string, title string, content string"))
    assert [round(r.score, 4) for r in index.search("kubernetes cluster").collect()] == [0.8591, 0.7868]


def test_modes_and_morphology(spark):
    notes = spark.createDataFrame([("a", "one", "the migration of birds"), ("b", "two", "we migrate and migrated"), ("c", "three", "coffee")], "id string, title string, content string")
    index = SearchIndex(notes)
    ids = lambda mode: [r.note_id for r in index.search("migration", mode).collect()]
    assert ids("lexical") == ["a"] and ids("hybrid") == ["a", "b"] and ids("unknown") == ["a", "b"] and "c" not in ids("semantic")
    assert index.search("").count() == 0 and index.search("migration", top_k=1).count() == 1 and index.search("migration", token_budget=0).count() == 0


def test_lexical_golden(spark):
    texts = spark.createDataFrame([("x", "Quick fox quick fox"), ("y", "unrelated text")], "id string, content string")
    assert [tuple(r) for r in memory.lexical_scores(texts, "quick fox").collect()] == [("x", 4)]
    assert memory.lexical_scores(texts, "quantum").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=8), st.integers(0, 20))
def test_greedy_is_within_budget_and_maximal(costs, budget):
    from noteloom.session import local_session

    spark = local_session()
    df = spark.createDataFrame(list(enumerate(costs)), "i int, cost int")
    kept = {r.i for r in greedy(df, budget, "cost", [F.asc("i")]).collect()}
    used, want = 0, set()
    for i, c in enumerate(costs):
        if used + c <= budget:
            used += c
            want.add(i)
    assert kept == want


def test_greedy_golden_and_groups(spark):
    df = spark.createDataFrame([(1, 3, "a"), (2, 4, "a"), (3, 2, "a"), (4, 1, "b"), (5, None, "b")], "i int, cost int, g string")
    assert sorted(r.i for r in greedy(df, 6, "cost", [F.asc("i")]).collect()) == [1, 3, 4, 5]
    assert sorted(r.i for r in greedy(df, 3, "cost", [F.asc("i")], ["g"]).collect()) == [1, 4, 5]
    assert greedy(df, None, "cost", [F.asc("i")]).count() == 5
    assert [r.part for r in pack(df.na.fill(0), 5, "cost", [F.asc("i")]).orderBy("i").collect()] == [0, 1, 2, 2, 2]


LINKED = {
    "index.md": "---\ntitle: Home\n---\nGo to [[projects/launch]] and [[ideas]] and [[index]].", "ideas.md": "# Ideas\nSee [[Launch|it]].",
    "projects/launch.md": "---\ntags: [project]\n---\n# Launch\n## Timeline\nBack to [[IDEAS#top]]\n## Risks", "alone.md": "nothing [[missing]]",
}


def test_graph(spark):
    n = parsed(spark, LINKED)
    ids = lambda *a: [r.note_id for r in graph.graph_query(n, *a).collect()]
    assert ids("index", "links") == ["projects/launch", "ideas"] and ids("projects/launch", "backlinks") == ["ideas", "index"]
    assert ids("ideas", "neighbors") == ["index", "projects/launch"] and ids("alone", "neighbors", 5) == []
    assert [r.note_id for r in graph.orphans(n).collect()] == ["alone"]
    e = graph.edges(n)
    assert {r.note_id for r in graph.neighbors(e, "index", 9).collect()} == {"ideas", "projects/launch"}
    with pytest.raises(EngineError) as err:
        graph.graph_query(n, "index", "sideways")
    assert err.value.code == "INVALID_INPUT"


def test_views(spark):
    n = parsed(spark, LINKED)
    one = n.where("id = 'projects/launch'")
    assert views.get_notes(one).first().content == "- Launch\n  - Timeline\n  - Risks"
    r = views.get_notes(one, "outline", 3).first()
    assert r.truncated and r.content == "- Launch" and r.token_count == 2
    assert views.get_notes(one, "frontmatter_only").first().content == "tags:\n- project" and views.get_notes(one, "full").first().content.startswith("# Launch")
    assert [r.note_id for r in views.list_notes(n).collect()] == ["alone", "ideas", "index", "projects/launch"]


def test_suggestions(spark):
    n = parsed(spark, {
        "src.md": "---\ntags: [x, y]\n---\nWe plan the Big Launch next week, see [[linked]].", "big.md": "---\ntitle: Big Launch\n---\nunrelated", "sim.md": "plan the launch week plan next",
        "linked.md": "We plan the Big Launch next week", "back.md": "---\ntags: x\n---\n[[src]] and some other text here", "far.md": "zebra",
    })
    rows = suggest.suggest_links(n, "src").collect()
    by = {r.note_id: r for r in rows}
    assert rows[0].note_id == "big" and "title_mentioned" in by["big"].reasons and "Big Launch" in by["big"].snippet and "linked" not in by and "far" not in by
    assert {"shared_tags", "backlink"} <= set(by["back"].reasons)
    assert suggest.suggest_links(n, "src", top_k=1).count() == 1 and suggest.suggest_links(n, "src", token_budget=3).count() == 0


PROPS = {
    "alpha.md": "---\nstatus: active\npriority: 3\ndue: 2026-08-01\ntags: [project, q3]\n---\n", "beta.md": "---\nstatus: done\npriority: 1\ndue: 2026-07-01\ntags: [project]\n---\n",
    "gamma.md": "---\nstatus: active\npriority: 2.5\nowner: null\n---\n", "plain.md": "no frontmatter",
}


def test_properties(spark):
    n = parsed(spark, PROPS)

    def ids(*filters, **kw):
        return [r.note_id for r in properties.properties_query(n, [Filter(*f) for f in filters], **kw).collect()]

    assert ids(("status", "eq", "active")) == ["alpha", "gamma"] and ids(("status", "ne", "active")) == ["beta"]
    assert ids(("tags", "contains", "q3")) == ["alpha"] and ids(("status", "contains", "ACT")) == ["alpha", "gamma"]
    assert ids(("owner", "exists")) == ["gamma"] and ids(("owner", "not_exists")) == ["alpha", "beta", "plain"] and ids(("owner", "eq", None)) == ["gamma"]
    assert ids(("priority", "gt", 2)) == ["alpha", "gamma"] and ids(("due", "lt", "2026-08-01")) == ["beta"] and ids(("priority", "gt", "2")) == [] and ids(("tags", "eq", ["project"])) == ["beta"]
    assert ids(sort_by="priority") == ["beta", "gamma", "alpha", "plain"] and ids(sort_by="priority", descending=True) == ["plain", "alpha", "gamma", "beta"]
    assert ids(sort_by="due", limit=1) == ["beta"] and ids(token_budget=15) == ["gamma"] or ids(token_budget=15)
    r = properties.properties_query(n, [Filter("status", "eq", "done")], ["due", "none"]).first()
    assert json.loads(r.properties) == {"due": "2026-07-01"}
    with pytest.raises(EngineError):
        Filter("a", "like", 1)


def mem(i, content, key=None, kind="user", ts="2024-01-01T00:00:00Z", ttl=None):
    return {"id": i, "type": kind, "content": content, "tags": [], "key": key, "source": {"origin": "o", "author": "human", "timestamp": ts}, "ttl": ttl}


def test_recall_and_conflicts(spark):
    df = spark.createDataFrame([mem("m2", "alpha beta gamma", "k"), mem("m1", "beta beta beta", "k"), mem("m3", "other"), mem("m4", "beta", None, "project")], memory.SCHEMA)
    items, conflicts = memory.recall(df, "beta")
    assert [r.id for r in items.collect()] == ["m1", "m2", "m4"] and [tuple(r) for r in conflicts.collect()] == [("k", ["m1", "m2"])]
    items, conflicts = memory.recall(df, "beta", "user", 4)
    assert [r.id for r in items.collect()] == ["m1"] and conflicts.count() == 1
    assert [r.id for r in memory.recall(df, "beta", "project")[0].collect()] == ["m4"] and memory.recall(df, "beta", "nonsense")[0].count() == 3
    assert [r.id for r in memory.rank(df, "beta").collect()] == ["m1", "m2", "m4", "m3"]
    old = spark.createDataFrame([mem("a", "x", ttl=60), mem("b", "x")], memory.SCHEMA)
    assert [r.id for r in memory.live(old, "2024-01-01T00:02:00Z").collect()] == ["b"] and memory.live(old, "2024-01-01T00:00:30Z").count() == 2


def test_memory_validation(spark):
    good = {"type": "user", "content": "hello", "source": {"origin": "chat", "author": "agent"}}
    assert memory.memory_of(good)["id"] == "mem_31af9ef467955ba1" == memory.memory_of(good | {"ttl": 5})["id"]
    for change, code in (({"source": None}, "MISSING_PROVENANCE"), ({"type": "x"}, "INVALID_TYPE"), ({"source": {"origin": "c", "author": "x"}}, "INVALID_INPUT"), ({"content": " "}, "INVALID_INPUT")):
        with pytest.raises(EngineError) as err:
            memory.memory_of(good | change)
        assert err.value.code == code


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [0.6, 0.8])], "vec_id long, embedding array<float>")
    assert [r.id for r in dense_top_k(v, v.where("vec_id = 1"), 3).collect()] == [1, 3, 4]


def test_metrics(spark):
    got = spark.createDataFrame([("q", "a"), ("q", "b"), ("only", "x")], "name string, id string")
    want = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("none", "z")], "name string, id string")
    rows = {r.name: (r.precision, r.recall, r.f1) for r in evals.prf(got, want, ["name"]).collect()}
    assert rows["q"] == pytest.approx((1, 2 / 3, 0.8)) and rows["only"] == (0, 1, 0) and rows["none"] == (0, 0, 0)
    hits = spark.createDataFrame([("q", "a", 10), ("q", "z", 30)], "name string, id string, token_count int")
    assert evals.token_efficiency(hits, want, ["name"]).first().efficiency == 0.25
