from pyspark.sql import functions as F

from noteloom.functions import parsing, text
from noteloom.functions.yamlio import dumps, mapping_json
from noteloom.operators.tasks import list_tasks, toggle_line, toggled

PARSE = """---
title: Launch plan
tags: [project, q1]
due: 2026-08-01
---
# Heading One
See [[people/Ann|Ann]] and [[spec#Goals]] and [[log#^b1]]. #urgent
## Two
text # not a heading
### Three   
"""


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalar_golden_values(spark):
    r = one(
        spark, text.estimate_tokens(F.lit("")), text.estimate_tokens(F.lit("abcd")), text.estimate_tokens(F.lit("abcde")), text.fnv1a(F.lit("w:migration")), text.fnv1a(F.lit("t:#mi")),
        text.stable_id(F.lit("user  hello chat agent"), "mem"), text.stable_id(text.memory_seed(F.lit("user"), F.lit(None), F.lit("hello"), F.lit("chat"), F.lit("agent")), "mem"),
    )
    assert tuple(r) == (0, 1, 2, 2108976808, 2943448706, "mem_31af9ef467955ba1", "mem_31af9ef467955ba1")


def test_tokens_and_features(spark):
    r = one(spark, text.tokenize(F.lit("Zürich: quick-FOX 42")), text.features(F.lit("fox")), text.tokenize(F.lit(None).cast("string")))
    assert r[0] == ["z", "rich", "quick", "fox", "42"]
    assert r[1] == ["w:fox", "t:#fo", "t:fox", "t:ox#"] and r[2] == []


def test_snippet_and_truncation(spark):
    long = "a " * 100 + "needle " + "b " * 200
    r = one(spark, text.snippet(F.lit("needle"), F.lit(long)), text.truncate_words(F.lit("one two three four"), 2), text.truncate_words(F.lit("short"), 2), text.clip(F.lit("abcdefgh"), 1))
    assert r[0].startswith("a a") and "needle" in r[0] and len(r[0]) == 240
    assert r[1] == "one two" and r[2] == "short" and tuple(r[3]) == ("abcd", True)


def test_mentions(spark):
    toks = text.tokenize(F.lit("we talk about the big launch today"))
    r = one(spark, text.mentions(toks, F.lit("Big Launch"), F.lit("x")), text.mentions(toks, F.lit("zz"), F.lit("today")), text.mentions(toks, F.lit("we"), F.lit("x")))
    assert tuple(r) == (True, True, False)


def test_parse_note(spark):
    raw = spark.createDataFrame([("projects/plan.md", PARSE), ("bare.md", "no title here"), ("crlf.md", "---\r\ntitle: x\r\n---\r\nbody"), ("empty.md", None), ("bad.md", "---\n: [\n---\nbody")], "path string, raw string")
    got = {r.id: r for r in parsing.parse_notes(raw).withColumn("fm", F.to_json("frontmatter")).drop("frontmatter").collect()}
    n = got["projects/plan"]
    assert n.title == "Launch plan" and [h.level for h in n.headings] == [1, 2, 3] and n.headings[2].text == "Three" and n.headings[0].slug == "heading-one"
    assert [(x.target, x.heading, x.block, x.alias) for x in n.links] == [("people/Ann", None, None, "Ann"), ("spec", "Goals", None, None), ("log", None, "b1", None)]
    assert n.tags == ["project", "q1", "urgent"] and '"due":"2026-08-01"' in n.fm and n.content.startswith("# Heading One")
    assert got["bare"].title == "bare" and got["crlf"].fm == "{}" and got["crlf"].content.startswith("---\r\n") and got["empty"].content == "" and got["bad"].fm == "{}" and got["bad"].content == "body"


def test_yaml_core_schema():
    assert mapping_json("a: 2026-08-01\nb: yes\nc: 012\nd: 1e3\ne: true\nf: null\ng: 1.5") == '{"a": "2026-08-01", "b": "yes", "c": 12, "d": 1000.0, "e": true, "f": null, "g": 1.5}'
    assert mapping_json("- a\n- b") == "{}" and mapping_json(None) == "{}" and dumps({}) == "" and dumps({"b": 1, "a": ["x"]}) == "b: 1\na:\n- x\n"


TASKS = [("plans", "intro\n- [ ] ship \U0001f4c5 2026-08-10 #launch\n  * [X] old\n- [] no\n"), ("today", "- [ ] call due:2026-07-25 #launch\r\n- [x] done\n- [ ] undated")]


def test_tasks(spark):
    notes = spark.createDataFrame(TASKS, "id string, content string")
    got = [(r.note_id, r.line, r.text, r.done, r.due, r.tags) for r in list_tasks(notes).collect()]
    assert got == [
        ("today", 0, "call due:2026-07-25 #launch", False, "2026-07-25", ["launch"]), ("plans", 1, "ship \U0001f4c5 2026-08-10 #launch", False, "2026-08-10", ["launch"]),
        ("plans", 2, "old", True, None, []), ("today", 1, "done", True, None, []), ("today", 2, "undated", False, None, []),
    ]
    assert list_tasks(notes, due_before="2026-08-10").count() == 1 and list_tasks(notes, due_after="2026-08-10").count() == 1
    assert list_tasks(notes, tag="launch", done=False, limit=1).count() == 1 and list_tasks(notes, token_budget=24).count() == 2


def test_toggle(spark):
    assert toggle_line("- [ ] a\n- [x] b", 1, "b") == "- [ ] a\n- [ ] b"
    r = one(spark, toggled(F.lit("x\n- [ ] a\n- [x] b"), F.lit(1)), toggled(F.lit("x\n- [ ] a\n- [x] b"), F.lit(2)))
    assert tuple(r) == ("x\n- [x] a\n- [x] b", "x\n- [ ] a\n- [ ] b")


def test_template_vars(spark):
    assert one(spark, parsing.template_vars(F.lit("{{ title }} {{date}} {{p}} {{title}}")))[0] == ["title", "p"]
