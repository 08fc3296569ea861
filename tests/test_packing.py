import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators.packing import pack


def fold(sizes, limit):
    part, used, out = -1, None, []
    for c in sizes:
        if used is None or used + c > limit:
            part, used = part + 1, c
        else:
            used += c
        out.append(part)
    return out


@pytest.mark.parametrize(
    ("n", "limit", "most", "cell"),
    [(600, 50, 20, 16), (200, 0, 2, 8), (64, 100_000, 5, 16), (1, 5, 9, 4), (97, 30, 29, 97)],
)
def test_packing_equals_the_fold(spark, n, limit, most, cell):
    """Sizes of 0 and null, runs of them, rows beyond the limit, parts over many cells, cells of one row."""
    rng = random.Random(n + limit)
    sizes = [rng.choice([0, 0, rng.randrange(most + 1), rng.randrange(most + 1)]) for _ in range(n)]
    df = spark.createDataFrame([(i, sizes[i] if sizes[i] or i % 2 else None, f"x{i}") for i in range(n)], "id int, size int, t string").repartition(5)
    got = sorted((r.id, r.t, r.part) for r in pack(df, limit, "size", [F.asc("id")], cell=cell).collect())
    assert got == [(i, f"x{i}", p) for i, p in enumerate(fold(sizes, limit))]


def test_descending_order_ties_and_no_rows(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id int, size int")
    got = pack(df, 4, "size", [F.desc("size"), F.asc("id")], cell=8).orderBy(F.desc("size"), "id").collect()
    assert [r.part for r in got] == fold([r["size"] for r in got], 4)
    empty = pack(df.where("false"), 4, "size", [F.asc("id")])
    assert empty.count() == 0 and empty.columns == ["id", "size", "part"]


def test_no_step_is_one_task(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("size"))
    plan = pack(df, 20, "size", [F.asc("id")], cell=100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "RoundRobin" not in plan and "hashpartitioning(__cell" in plan
