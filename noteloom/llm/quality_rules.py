"""Quality rules with thresholds adapted to each language and source.

1. One pass over whole texts gives integer counts per document.
2. Each (lang, source) group gets a mergeable quantile sketch per metric: a histogram over
   relative-error bins (exponent and 5 mantissa bits of the integer metric, so a bin is at most 1/32
   wide). Sketches merge by adding bin counts: groups into languages, languages into the corpus.
3. A group's fences come from its own quantiles. Word length has Tukey's fences: ``SPREAD`` interquartile ranges beyond the
   quartiles. Rates are 0 in most documents, so theirs is the lower of two: ``RATE_SPREAD`` ranges beyond the quartiles of
   those that aren't 0, and the first place where the sketch leaps, from one of its upper quantiles to the next, by a
   factor of ``LEAP`` or more. What counts as little is one event in the group's median document.
4. A fence is drawn towards that of the language, and the language's towards the corpus's, with the weight of
   ``PRIOR`` documents, so groups of any size are treated alike.
5. The fences are joined to the documents, and those beyond one are rejected.

The sketch has at most 64 * 32 bins for each metric and group, whatever the number of documents; it is
deterministic, and plain SQL gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.llm.common import row_slices, staged, text_buffers
from noteloom.llm.textvec import repeated, row_hash, span_hash, window_hash, word_spans

#: Documents that a parent's fence weighs beside a group's own.
PRIOR = 50
#: Interquartile ranges beyond the quartiles: of word lengths, and of rates that aren't 0.
SPREAD, RATE_SPREAD = 4, 8
#: A quantile this many times the one before, and one event, is out of the group's habit.
LEAP = 16
#: Quantiles in percent between which leaps are looked for.
GRID = (50, 75, 90, 95, 98, 99, 100)
#: Name -> integer metric in SQL. Rates are per 1000 words.
LENGTH = "(100 * word_chars) div n_words"
RATES = {"symbols": "(1000 * n_symbols) div n_words", "repeats": "(1000 * n_repeat_words) div n_words", "dup_lines": "(1000 * n_dup_lines) div n_words"}
METRICS = {"words": "n_words", "word_length": LENGTH, **RATES}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
CONTRACT = ["doc_id", *BASE, "base_failed", "kept"]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def counts_of(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of a text buffer."""
    n = len(offs) - 1
    out = {k: np.zeros(n, np.int64) for k in BASE}
    if not len(buf):
        return out
    starts, ends, row = word_spans(buf, offs)
    out["n_words"] = np.bincount(row, minlength=n).astype(np.int64)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    out["word_chars"] = np.bincount(row, weights=lead[ends] - lead[starts], minlength=n).astype(np.int64)
    marks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SYMBOLS[buf], out=marks[1:])
    out["n_symbols"] = marks[offs[1:]] - marks[offs[:-1]]
    # every \n ends a line, and so does the end of the row
    breaks = np.flatnonzero(buf == 10)
    line_row = np.concatenate([np.searchsorted(offs, breaks, side="right") - 1, np.arange(n)])
    line_end = np.concatenate([breaks, offs[1:]])
    order = np.lexsort((line_end, line_row))
    line_row, line_end = line_row[order], line_end[order]
    line_start = np.zeros_like(line_end)
    same = line_row[1:] == line_row[:-1]
    line_start[1:] = np.where(same, line_end[:-1] + 1, offs[line_row[1:]])
    solid = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row, line_start, line_end = line_row[solid], line_start[solid], line_end[solid]
    if len(line_row):
        key = np.unique(row_hash(span_hash(buf, line_start, line_end), line_row))
        bits = max(1, int(line_row.max()).bit_length())
        distinct = np.bincount((key >> np.uint64(64 - bits)).astype(np.int64), minlength=n)
        out["n_dup_lines"] = np.bincount(line_row, minlength=n) - distinct
    h, at = window_hash(span_hash(buf, starts, ends), row, 3)
    if len(h):
        again = at[repeated(h, row[at])]
        covered = np.zeros(len(starts), bool)
        for j in range(3):
            covered[again + j] = True
        out["n_repeat_words"] = np.bincount(row[covered], minlength=n).astype(np.int64)
    return out


def measure(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The columns ``carried`` and the base counts of each whole text (null: empty)."""
    rows = docs.select(F.col("text").cast("string").alias("__text"), *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for lo, hi in row_slices(offs):
                part = counts_of(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                cols = [batch.column(i + 1).slice(lo, hi - lo) for i in range(len(carried))]
                cols += [pa.array(part[k], pa.int64()) for k in BASE]
                yield pa.RecordBatch.from_arrays(cols, names=[*carried, *BASE])

    schema = T.StructType([*rows.schema.fields[1:], *[T.StructField(k, T.LongType()) for k in BASE]])
    return rows.mapInArrow(run, schema)


def _base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def sketches(measured: DataFrame) -> DataFrame:
    """Bin counts (lang, source, metric, bin, low, n) of documents that pass the base rules.

    Additive: sketches of parts of a corpus merge by summing n for equal keys.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(sql).cast("long").alias("value")) for k, sql in METRICS.items()])
    rows = measured.where(~_base_failed()).select("lang", "source", F.explode(pairs).alias("m")).select("lang", "source", "m.*")
    drop = F.greatest(F.length(F.bin("value")) - 6, F.lit(0))
    low = F.expr("shiftleft(shiftright(value, d), d)")
    return rows.withColumn("d", drop).withColumn("low", low).groupBy("lang", "source", "metric", "low").agg(F.count("*").alias("n"))


def _walk(bins: str, total: str, percent: int) -> str:
    """SQL: the lower edge of the bin that holds rank ceil(percent / 100 * total)."""
    return f"""aggregate({bins}, named_struct('left', ({total} * {percent} + 99) div 100, 'low', -1L),
        (a, b) -> named_struct('left', a.left - b.n, 'low', if(a.low < 0 AND a.left - b.n <= 0, b.low, a.low))).low"""


def _bounds() -> list[str]:
    return ["word_length_hi", "word_length_lo", *[f"{k}_hi" for k in RATES]]


def _own(q: Callable[[str, str], str]) -> dict[str, str]:
    """SQL of a group's own fences; ``q`` names a metric's quantile (q50, n25 without zeros and the like)."""
    one = f"greatest(1, 1000 div greatest(1, {q('words', 'q50')}))"
    low, high = q("word_length", "n25"), q("word_length", "n75")
    out = {
        "word_length_hi": f"{high} + {SPREAD} * ({high} - {low}) + {high} div 32 + 1",
        "word_length_lo": f"greatest(0, {low} - {SPREAD} * ({high} - {low}) - {low} div 32 - 1)",
    }
    for k in RATES:
        leaps = [f"CASE WHEN {q(k, f'q{b}')} >= {LEAP} * ({q(k, f'q{a}')} + {one}) THEN {LEAP} * ({q(k, f'q{a}')} + {one}) END" for a, b in zip(GRID, GRID[1:], strict=False)]
        high = q(k, "n75")
        out[f"{k}_hi"] = f"least({high} + {RATE_SPREAD} * ({high} - {q(k, 'n25')}) + {high} div 32 + {one}, {', '.join(leaps)})"
    return out


def _drawn(own: str, parent: str, n: str) -> str:
    """SQL: a fence drawn towards its parent's; where one of them is missing, the other."""
    return f"CASE WHEN {own} IS NULL THEN {parent} WHEN {parent} IS NULL THEN {own} ELSE ({n} * {own} + {PRIOR} * {parent}) div ({n} + {PRIOR}) END"


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, a column for each bound): the fences of each group; null where no document has the metric above 0."""
    cube = sketch.withColumn("lv", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "lv",
        F.when(F.col("lv") < 2, F.col("lang")).alias("lang"),
        F.when(F.col("lv") < 1, F.col("source")).alias("source"),
        "metric",
        "low",
        "n",
    )
    bins = cube.groupBy("lv", "lang", "source", "metric", "low").agg(F.sum("n").alias("n"))
    key = ["lv", "lang", "source"]
    folded = bins.groupBy(*key, "metric").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("low", "n"))).alias("bins"))
    some = folded.withColumn("above", F.expr("filter(bins, b -> b.low > 0)")).withColumn("some", F.expr("aggregate(above, 0L, (a, b) -> a + b.n)"))
    q = F.struct(
        *[F.expr(_walk("bins", "total", p)).alias(f"q{p}") for p in GRID], *[F.when(F.col("some") > 0, F.expr(_walk("above", "some", p))).alias(f"n{p}") for p in (25, 75)]
    )
    read = some.select(*key, "metric", "total", q.alias("q"))
    wide = read.groupBy(*key).agg(F.max("total").alias("n"), *[F.max(F.when(F.col("metric") == k, F.col("q"))).alias(f"m_{k}") for k in METRICS])
    own = staged(wide.select(*key, "n", *[F.expr(sql).cast("long").alias(b) for b, sql in _own(lambda k, at: f"m_{k}.{at}").items()]), "own-fences")
    parts = [own.where(F.col("lv") == lv).select(*names, *[F.col(c).alias(f"{c}{lv}") for c in ["n", *_bounds()]]) for lv, names in ((0, ["lang", "source"]), (1, [F.col("lang").alias("l")]), (2, []))]
    both = parts[0].join(parts[1], F.col("lang").eqNullSafe(F.col("l"))).join(parts[2], F.lit(True))
    made = []
    for b in _bounds():
        parent = _drawn(f"{b}1", f"{b}2", "n1")
        made.append(F.expr(_drawn(f"{b}0", f"({parent})", "n0")).alias(b))
    return both.select("lang", "source", *made)


def verdicts(measured: DataFrame) -> DataFrame:
    """Append base_failed, the fences of the document's group and kept to measured rows."""
    found = staged(fences(sketches(measured)), "fences").select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *_bounds())
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    out = measured.withColumn("base_failed", _base_failed()).join(found, same, "left").drop("__lang", "__source")
    inside = [F.expr(f"coalesce({LENGTH} <= word_length_hi AND {LENGTH} >= word_length_lo, true)"), *[F.expr(f"coalesce({sql} <= {k}_hi, true)") for k, sql in RATES.items()]]
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(reduce(and_, inside)))


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base verdict, adaptive fences and the verdict ``kept`` of each document.

    Input columns: doc_id, text, lang, source; others are ignored. Null text counts as empty and
    fails the base rules. Null languages and sources form groups of their own. A document on a fence is
    kept. Repeated rows are judged (and counted in the sketches) as often as they occur. If no document
    passes the base rules there are no fences and none is kept. Texts may be of any length; an empty table gives an empty
    result, and columns beside those named are ignored.

    The fences are a row for each group, so Spark's own size check decides whether they are broadcast; a shuffled join
    can be split by skew handling, as both its sides are read from written tables.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return verdicts(staged(measure(rows, ["doc_id", "lang", "source"]), "counts"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` would keep, with all their columns unchanged.

    The whole row travels as one struct beside its counts, so columns of any name are safe.
    """
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    out = verdicts(staged(measure(rows, ["__row", "lang", "source"]), "counted-docs"))
    return out.where("kept").select("__row.*")


def oracle_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the contract columns, by a plain reading of the rules."""
    sql = {k: v.replace(" div ", " // ") for k, v in METRICS.items()}
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS v FROM good" for k, v in sql.items())
    quantiles = [f"min(low) FILTER (upto >= (total * {p} + 99) // 100) AS q{p}" for p in GRID]
    quantiles += [f"min(low) FILTER (low > 0 AND upto - zero >= ((total - zero) * {p} + 99) // 100) AS n{p}" for p in (25, 75)]
    names = [f"q{p}" for p in GRID] + ["n25", "n75"]
    wide = [f"max({c}) FILTER (metric = '{k}') AS {k}_{c}" for k in METRICS for c in names]
    own = [f"{v.replace(' div ', ' // ')} AS {b}" for b, v in _own(lambda k, at: f"{k}_{at}").items()]
    drawn = []
    for b in _bounds():
        parent = _drawn(f"b.{b}", f"c.{b}", "b.n")
        drawn.append(_drawn(f"a.{b}", f"({parent})", "a.n").replace(" div ", " // ") + f" AS {b}")
    ok = [f"coalesce({sql['word_length']} <= word_length_hi AND {sql['word_length']} >= word_length_lo, true)", *[f"coalesce({sql[k]} <= {k}_hi, true)" for k in RATES]]
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM {documents}),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w),
dup AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
counts AS (
  SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
good AS (SELECT * FROM judged WHERE NOT base_failed),
vals AS ({pairs}),
lows AS (
  SELECT lang, source, metric,
         (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS low FROM vals),
lev AS (
  SELECT 0 AS lv, lang, source, metric, low FROM lows
  UNION ALL SELECT 1, lang, NULL, metric, low FROM lows
  UNION ALL SELECT 2, NULL, NULL, metric, low FROM lows),
bins AS (SELECT lv, lang, source, metric, low, count(*) AS n FROM lev GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, metric ORDER BY low) AS upto,
         sum(n) OVER (PARTITION BY lv, lang, source, metric) AS total,
         coalesce(sum(n) FILTER (low = 0) OVER (PARTITION BY lv, lang, source, metric), 0) AS zero FROM bins),
q AS (SELECT lv, lang, source, metric, max(total) AS total, {", ".join(quantiles)} FROM cum GROUP BY lv, lang, source, metric),
m AS (SELECT lv, lang, source, max(total) AS n, {", ".join(wide)} FROM q GROUP BY lv, lang, source),
own AS (SELECT lv, lang, source, n, {", ".join(own)} FROM m),
f AS (
  SELECT a.lang, a.source, {", ".join(drawn)} FROM own a JOIN own b ON b.lv = 1 AND a.lang IS NOT DISTINCT FROM b.lang JOIN own c ON c.lv = 2
  WHERE a.lv = 0)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
       CASE WHEN j.base_failed THEN false ELSE {" AND ".join(ok)} END AS kept
FROM judged j LEFT JOIN f ON f.lang IS NOT DISTINCT FROM j.lang AND f.source IS NOT DISTINCT FROM j.source
"""
