"""Mixing sources to target weights by Poisson replication.

A source with n documents and weight w gets the mean repetition rate  w / sum(w) * rows / n. Each
document's count is the inverse of the Poisson distribution with that mean at a uniform number hashed
from seed, source and doc_id. The document is exploded by its count and every copy gets a hashed
60-bit shuffle key; rows are dealt by the key's leading bits and sorted by it, so the key is the global
order. Means above ``PIECE`` are sums of independent pieces, as exp(-mean) would vanish.

DataFrame functions only. What is joined to the documents is a row for each source, broadcast behind a check of their
number; with more sources the join shuffles, and skew handling may split a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import checkpointed

SEED = 20_240_601
#: Largest mean that one inverted distribution covers.
PIECE = 32.0
#: Sources up to which their rates are broadcast: a row has at most 128 values, so 10 MB in all.
BROADCAST_SOURCES = 10_000
#: Leading bits of the shuffle key that choose a partition.
DEAL_BITS = 24


def _unit_sql(text: str) -> str:
    return f"cast(conv(substring(md5({text}), 1, 13), 16, 10) as double) / 4503599627370496.0D"


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None) -> DataFrame:
    """(source, rate, pieces, cdf) for each source of ``docs``; sources missing in ``weights`` get rate 0.

    ``weights`` None means equal weights; ``rows`` None means as many rows as ``docs`` has.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights can't be negative")
        known = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else F.expr("map('', 0D)")
        weighted = counts.withColumn("w", F.coalesce(F.element_at(known, F.coalesce("source", F.lit(""))), F.lit(0.0)))
    total = weighted.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    goal = F.lit(float(rows)) if rows is not None else F.col("all_n").cast("double")
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(F.lit(0.0))
    # the other side is one row of totals
    rated = weighted.join(F.broadcast(total), F.lit(True)).select("source", (share * goal / F.col("n")).alias("rate"))
    pieced = rated.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    return pieced.withColumn("cdf", F.expr(cdf_sql("rate / pieces")))


def cdf_sql(mean: str) -> str:
    """SQL for the values P(X <= 0), P(X <= 1), ... of a Poisson variable, to where they reach 1."""
    return f"""transform(aggregate(sequence(1, cast(ceil({mean} + 12 * sqrt({mean}) + 24) as int)),
        array(named_struct('p', exp(-({mean})), 'c', exp(-({mean})))),
        (acc, k) -> concat(acc, array(named_struct('p', element_at(acc, -1).p * ({mean}) / k,
            'c', element_at(acc, -1).c + element_at(acc, -1).p * ({mean}) / k)))), x -> x.c)"""


def _identity(prefix: str) -> str:
    return f"concat('{prefix}', '|', coalesce(__src, ''), '|', coalesce(cast(__id as string), ''))"


def copies(seed: int = SEED) -> Column:
    """The Poisson count of a row that has __src, __id, pieces and cdf."""
    u = _unit_sql(f"concat({_identity(f'n{seed}')}, '|', cast(j as string))")
    return F.expr(f"aggregate(sequence(0, pieces - 1), 0, (a, j) -> a + size(filter(cdf, c -> c <= {u})))")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` for each copy, with __copy (0, 1, ...) and __order, the global position key.

    Needs source and doc_id. Null sources are a source of their own (never named in ``weights``, so
    of rate 0 if weights are given). The count hangs on source and doc_id alone, so rows that share both
    are repeated alike, and rows with null doc_id of a source are too. An empty table gives an empty one; texts may be
    of any length, and columns of any names travel along. Rows are dealt to partitions by the leading bits of their
    order, hashed, and lie in order within a partition; partitions, and so files, aren't in order among themselves.
    """
    rates = checkpointed(source_rates(docs, weights, rows))
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("source").cast("string").alias("__src"), F.col("doc_id").alias("__id")
    )
    side = rates.withColumnRenamed("source", "__key")
    if rates.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    rated = row.join(side, F.col("__src").eqNullSafe(F.col("__key")))
    counted = rated.select("__row", "__src", "__id", copies(seed).alias("__n")).where("__n > 0")
    out = counted.select("__row", "__src", "__id", F.explode(F.expr("sequence(0, __n - 1)")).alias("__copy"))
    key = F.expr(f"cast(conv(substring(md5(concat({_identity(f'o{seed}')}, '|', cast(__copy as string))), 1, 15), 16, 10) as bigint)")
    keyed = out.select("__row", "__copy", key.alias("__order"))
    dealt = keyed.repartition(F.shiftright("__order", 60 - DEAL_BITS)).sortWithinPartitions("__order", "__copy")
    return dealt.select("__row.*", "__copy", "__order")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, seed: int = SEED) -> DataFrame:
    """``replicate`` with the columns of ``docs`` only."""
    return replicate(docs, weights, rows, seed).drop("__copy", "__order")


def oracle_sql(documents: str = "documents", seed: int = SEED) -> str:
    """DuckDB SQL for the mixing query: equal weights, as many rows as there are documents."""
    unit = f"(('0x' || substr(md5('n{seed}|' || coalesce(source, '') || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(j AS VARCHAR)), 1, 13))::BIGINT) / 4503599627370496.0"
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM n)) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
p AS (SELECT source, greatest(ceil(rate / {PIECE}::DOUBLE), 1)::BIGINT AS pieces, rate FROM r),
steps AS (
  SELECT source, pieces, rate / pieces AS m, 0 AS k, exp(-(rate / pieces)) AS p, exp(-(rate / pieces)) AS c FROM p
  UNION ALL
  SELECT source, pieces, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM steps WHERE k < ceil(m + 12 * sqrt(m) + 24)),
cdf AS (SELECT source, pieces, list(c ORDER BY k) AS cdf FROM steps GROUP BY source, pieces),
u AS (
  SELECT d.doc_id, d.source, d.lang, d.text, cdf.cdf, unnest(range(pieces)) AS j
  FROM {documents} d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
counts AS (
  SELECT doc_id, source, lang, text, sum(len(list_filter(cdf, lambda x: x <= {unit}))) AS n
  FROM u GROUP BY doc_id, source, lang, text),
e AS (SELECT doc_id, source, lang, text, unnest(range(n::BIGINT)) AS copy FROM counts)
SELECT doc_id, source, lang, text, CAST(copy AS INTEGER) AS copy,
       (('0x' || substr(md5('o{seed}|' || coalesce(source, '') || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)), 1, 15))::BIGINT) AS shuffle_key
FROM e
"""
