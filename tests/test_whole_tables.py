"""Queries that take the whole table, against brute force."""

from noteloom.plans import queries as core


def test_budget_walks_over_all_documents(spark, tmp_path):
    rows = [(i, "xy"[i % 2], "w" * (37 * i % 900)) for i in range(1, 200)] + [(200, "x", None), (201, None, "w" * 40)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    used, want = {}, set()
    for cost, doc, lang in sorted(((-(-len(t or "") // 4), d, g) for d, g, t in rows), key=lambda x: (-x[0], x[1])):
        if used.get(lang, 0) + cost <= 2500:
            used[lang] = used.get(lang, 0) + cost
            want.add((lang, doc, cost))
    got = [tuple(r) for r in core.budget_by_language(spark, f"file://{tmp_path}").collect()]
    assert len(got) == len(want) and set(got) == want and any(d % 40 for _, d, _ in got)


def test_snapshot_sets_of_all_events_are_judged(spark, tmp_path):
    ids = [i for i in range(1, 2001) if i % 97]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    want = sorted(u for u in range(0, 2004, 4) if u % 16 != 8 and all(u + k in set(ids) for k in range(4)))
    got = core.snapshot_complete(spark, f"file://{tmp_path}").collect()
    assert sorted(r.upto for r in got) == want and want[-1] > 400


def test_parts_go_over_batches(spark):
    import random

    from pyspark.sql import functions as F

    from noteloom.operators.packing import pack

    r = random.Random(2)
    for limit in (1, 1000):
        sizes = [r.choice([0, 1, 7, 49, 50, 51, 400, None]) for _ in range(3000)]
        want, part, used = [], -1, 0
        for c in sizes:
            c = c or 0
            if part >= 0 and used + c <= limit:
                used += c
            else:
                part, used = part + 1, c
            want.append(part)
        df = spark.createDataFrame(list(enumerate(sizes)), "i int, c int").repartition(5)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 128)
        try:
            got = {x.i: x.part for x in pack(df, limit, "c", [F.asc("i")]).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert [got[i] for i in range(3000)] == want
