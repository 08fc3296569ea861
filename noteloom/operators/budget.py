"""Greedy token budgets: an ordered fold that no window sum can express.

A window prefix sum is wrong here, as a row that doesn't fit is skipped and later, smaller rows still get
their chance. What has been used never shrinks, so of rows with equal cost the walk takes a first few in order: once
one doesn't fit, no later one does. Hence of each cost c only the first budget / c rows can matter. The rows
are cut to these, in parallel, before the fold, so what one task folds is bounded by budget * log(budget) whatever the
size of the input; free rows are always taken and skip the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(df: DataFrame, budget: int | None, cost: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The rows of ``df``, in ``order``, that a greedy walk takes: a row is taken if its cost still fits.

    Order must be total for a definite result. ``budget`` None takes all rows; with ``by`` each group has a budget
    of its own. Null costs count as 0. Columns stay as they are.
    """
    if budget is None:
        return df
    by = by or []
    price = F.coalesce(F.col(cost).cast("long"), F.lit(0).cast("long"))
    free = df.where(price <= 0)
    paid = df.where((price > 0) & (price <= budget)).withColumn("__c", price)
    nth = F.row_number().over(_window([*by, "__c"], order))
    # the constant bound lets Spark cut groups before the shuffle
    few = paid.withColumn("__n", nth).where(F.col("__n") <= max(int(budget), 1)).where(F.col("__n") <= F.expr(f"{int(budget)}L div __c")).drop("__n")
    rank = F.row_number().over(_window(by, order))
    row = F.struct(rank.alias("r"), F.col("__c").alias("c"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    ranked = few.select(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], row.alias("x"))
    folded = ranked.groupBy(*[f"__by{i}" for i in range(len(by))]).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    taken = F.expr(
        f"""aggregate(xs, named_struct('used', 0L, 'kept', cast(array() as array<int>)),
            (a, x) -> if(a.used + x.c <= {int(budget)}L,
                         named_struct('used', a.used + x.c, 'kept', concat(a.kept, array(x.r))), a)).kept"""
    )
    kept = folded.select("xs", taken.alias("kept")).select(F.explode(F.filter("xs", lambda x: F.array_contains("kept", x.r))).alias("x"))
    return kept.select("x.row.*").unionByName(free)


def _window(by: list[str], order: list[Column]):
    from pyspark.sql import Window

    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)

