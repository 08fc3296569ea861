"""Part packing of any number of rows: an ordered fold whose every step hangs on the one before, made parallel exactly.

Rows in order fill parts of at most a limit; a row that doesn't fit closes the part for good. Where a part begins at a row, the
next one begins at a row that the sizes alone tell: the first whose running sum is beyond the limit. So

1. rows are numbered and summed in order, range by range;
2. every row gets the row that would begin the next part, by one sort of running sums and thresholds;
3. rows are cut into cells of equal numbers, and within a cell pointers are doubled until they leave it;
4. between cells pointers are doubled again, from those rows only that another cell points to; each round doubles how
   far the parts are known from the first row on, so cells cost log2(cells) rounds;
5. each cell streams its rows through the plain fold, from the row at which a part is known to begin.

No task holds more than a cell, whose rows are bounded by ``CELL``, and no step reads all rows in one task. The driver sees a row
for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.sources.places import written

#: Rows of a cell: as many as make ``CELLS`` cells of all rows, within these bounds.
CELL, CELLS = (4096, 1 << 20), 1 << 14


def _summed(df: DataFrame, size: str, order: list[Column]) -> tuple[DataFrame, int]:
    """(rows, n): the columns with __c, the size, __pos, the row's number from 0, and __end, the sizes up to and with the row's."""
    spark = df.sparkSession
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("__c"))
    dealt = written(plain, "pack-rows").repartitionByRange(*order).sortWithinPartitions(*order)
    more = [T.StructField("__part", T.IntegerType()), T.StructField("__pos", T.LongType()), T.StructField("__end", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ends = np.cumsum(batch.column(batch.num_columns - 1).to_numpy()) + total
            places = np.arange(n, n + len(ends))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(places), pa.array(ends)], names=[*batch.schema.names, "__part", "__pos", "__end"])
            n += len(ends)
            total = int(ends[-1]) if len(ends) else total

    rows = written(dealt.mapInArrow(run, T.StructType([*plain.schema.fields, *more])), "pack-sums")
    sums = rows.groupBy("__part").agg(F.count("*").alias("n"), F.max("__end").alias("s")).orderBy("__part").collect()
    before, n, total = [], 0, 0
    for r in sums:
        before.append((r["__part"], n, total))
        n, total = n + r["n"], total + r["s"]
    start = F.broadcast(spark.createDataFrame(before, "__part int, __n0 long, __s0 long"))  # a row a partition
    return rows.join(start, "__part").select(*df.columns, "__c", (F.col("__pos") + F.col("__n0")).alias("__pos"), (F.col("__end") + F.col("__s0")).alias("__end")), n


def _following(rows: DataFrame, limit: int, n: int) -> DataFrame:
    """(pos, next): for a part that begins at a row, where the next one begins; ``n`` where no more does.

    Sums and thresholds are sorted together; the row that follows a threshold is the answer. A row beyond the limit is a part alone.
    """
    spark = rows.sparkSession
    sums = rows.select(F.col("__end").alias("v"), F.lit(0).alias("kind"), F.col("__pos").alias("pos"))
    fits = F.col("__c") <= limit
    asked = rows.where(fits).select((F.col("__end") - F.col("__c") + limit).alias("v"), F.lit(1).alias("kind"), F.col("__pos").alias("pos"))
    keys = ["v", "kind", "pos"]
    dealt = written(sums.union(asked), "pack-thresholds").repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, first = TaskContext.get().partitionId(), [], True

        def out(pos: np.ndarray, following: np.ndarray | None, head: bool = False) -> pa.RecordBatch:
            found = pa.array(following) if following is not None else pa.nulls(len(pos), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), part, np.int32)), pa.array(np.full(len(pos), head)), pa.array(pos), found], names=["part", "head", "pos", "next"])

        for batch in batches:
            kind, pos = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = np.flatnonzero(kind == 0)
            if len(at):
                if first:
                    yield out(pos[at[:1]], pos[at[:1]], True)  # the first row of the partition, for thresholds of those before
                    first = False
                for held in waiting:
                    yield out(held, np.full(len(held), pos[at[0]]))
                waiting = []
            q = np.flatnonzero(kind == 1)
            i = np.searchsorted(at, q)
            known = i < len(at)
            if known.any():
                yield out(pos[q[known]], pos[at[i[known]]])
            if not known.all():
                waiting.append(pos[q[~known]])
        for held in waiting:
            yield out(held, None)

    found = written(dealt.mapInArrow(run, "part int, head boolean, pos long, next long"), "pack-next")
    heads = sorted((r.part, r.pos) for r in found.where("head").collect())  # a row a partition at most
    after, following = [], n
    for p in range(found.agg(F.max("part")).first()[0] or 0, -1, -1):
        after.append((p, following))
        following = next((pos for q, pos in heads if q == p), following)
    far = F.broadcast(spark.createDataFrame(after, "part int, far long"))
    pointers = found.where("NOT head").join(far, "part").select("pos", F.coalesce("next", "far").alias("next"))
    return pointers.union(rows.where(~fits).select(F.col("__pos").alias("pos"), (F.col("__pos") + 1).alias("next")))


def _through_cells(pointers: DataFrame, cell: int, n: int) -> DataFrame:
    """(pos, leaves, hops): for the rows that another cell points to, and the first, where their chain of parts leaves the cell and after how many."""
    own = pointers.select(F.expr(f"pos div {cell}").alias("cell"), "pos", "next")
    entered = own.where(F.expr(f"next div {cell} <> cell AND next < {n}")).select("next").distinct().union(pointers.sparkSession.createDataFrame([(0,)], "next long"))
    marks = entered.select(F.expr(f"next div {cell}").alias("cell"), F.col("next").alias("pos"), F.lit(None).cast("long").alias("next"))

    def run(table: pa.Table) -> pa.Table:
        asked = table.column("next").is_null().to_numpy()
        pos = table.column("pos").to_numpy()
        rows = np.flatnonzero(~asked)
        rows = rows[np.argsort(pos[rows])]
        first = pos[rows[0]]
        to = table.column("next").combine_chunks().take(pa.array(rows)).to_numpy() - first
        size = len(rows)
        hops = np.ones(size, np.int64)
        while True:
            inside = np.flatnonzero(to < size)
            if not len(inside):
                break
            hops[inside] += hops[to[inside]]
            to[inside] = to[to[inside]]
        wanted = pos[asked] - first
        return pa.table({"pos": pos[asked], "leaves": to[wanted] + first, "hops": hops[wanted]})

    return own.union(marks).groupBy("cell").applyInArrow(run, "pos long, leaves long, hops long")


def part_starts(rows: DataFrame, limit: int, n: int, cell: int) -> DataFrame:
    """(cell, at, part): where the first part that begins in a cell begins, and its number; ``at`` is null where none does,
    and ``part`` then the one that goes on."""
    jumps = written(_through_cells(written(_following(rows, limit, n), "pack-pointers"), cell, n).withColumns({"to": F.col("leaves"), "many": F.col("hops")}), "pack-jumps")
    known = rows.sparkSession.createDataFrame([(0, 0)], "pos long, part long")
    steps = jumps.select("pos", "to", "many")
    reach = 1
    while reach < -(-n // cell):  # what is known doubles, as does how far a jump leads
        onward = known.join(steps, "pos").where(F.col("to") < n).select(F.col("to").alias("pos"), (F.col("part") + F.col("many")).alias("part"))
        known = written(known.union(onward), "pack-known")
        then = steps.select(F.col("pos").alias("to"), F.col("to").alias("to2"), F.col("many").alias("many2"))
        steps = written(steps.join(then, "to", "left").select("pos", F.coalesce("to2", "to").alias("to"), (F.col("many") + F.coalesce("many2", F.lit(0))).alias("many")), "pack-steps")
        reach *= 2
    here = known.join(jumps, "pos").withColumn("cell", F.expr(f"pos div {cell}"))
    # cells that a part goes through without another one beginning there
    last = f"if(leaves >= {n}, {n - 1} div {cell}, leaves div {cell} - 1)"
    over = here.where(f"{last} > cell").select(F.explode(F.expr(f"sequence(cell + 1, {last})")).alias("cell"), F.lit(None).cast("long").alias("at"), (F.col("part") + F.col("hops") - 1).alias("part"))
    return here.select("cell", F.col("pos").alias("at"), "part").union(over)


def pack(df: DataFrame, limit: int, size: str, order: list[Column], cell: int | None = None) -> DataFrame:
    """Add ``part``: rows in order fill parts of at most ``limit``; a part is closed, never revisited.

    A row larger than the limit gets a part of its own; null sizes count as 0, sizes aren't negative. ``order`` must be total for a definite
    result. ``cell``: rows that one task walks; from the number of rows by default.
    """
    out = T.StructType([*df.schema.fields, T.StructField("part", T.LongType())])
    rows, n = _summed(df, size, order)
    if not n:
        return df.sparkSession.createDataFrame([], out)
    cell = cell or min(max(CELL[0], -(-n // CELLS)), CELL[1])
    rows = written(rows, "pack-placed")
    starts = part_starts(rows.select("__c", "__pos", "__end"), limit, n, cell)
    mine = rows.select(F.expr(f"__pos div {cell}").alias("__cell"), "__pos", "__c", *df.columns)
    marks = starts.select(F.col("cell").alias("__cell"), F.lit(-1).cast("long").alias("__pos"), F.col("at").alias("__at"), F.col("part").alias("__part"))
    dealt = mine.unionByName(marks, allowMissingColumns=True).repartition("__cell").sortWithinPartitions("__cell", "__pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(limit)
        for batch in batches:
            pos, c = batch.column("__pos").to_numpy(), batch.column("__c").fill_null(0).to_numpy()
            found, i = np.zeros(len(pos), np.int64), 0
            for head in [*np.flatnonzero(pos < 0).tolist(), len(pos)]:
                found[i:head] = fold.walk(pos[i:head], c[i:head])
                if head < len(pos):
                    fold.enter(batch.column("__at")[head].as_py(), batch.column("__part")[head].as_py())
                i = head + 1
            made = pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in out.fields[:-1]], pa.array(found)], names=out.names)
            yield made.filter(pa.array(pos >= 0))

    return dealt.mapInArrow(run, out)


class _Fold:
    """The plain fold over rows in order, entered at a cell of which something is known."""

    def __init__(self, limit: int):
        self.limit, self.part, self.used, self.begins = limit, 0, 0, 0

    def enter(self, at: int | None, part: int) -> None:
        """Rows before ``at`` belong to the part that is open; ``at`` begins ``part``. None: the whole cell belongs to ``part``."""
        self.begins, self.part = (np.iinfo(np.int64).max, part) if at is None else (at, part - 1)

    def walk(self, pos: np.ndarray, c: np.ndarray) -> np.ndarray:
        found, i = np.empty(len(pos), np.int64), 0
        if self.begins is not None:
            i = int(np.searchsorted(pos, self.begins))
            found[:i] = self.part
            if i == len(pos):
                return found
            self.begins, self.used = None, self.limit + 1  # nothing fits any more
        total = np.concatenate([np.zeros(i + 1, np.int64), np.cumsum(c[i:])])
        while i < len(pos):
            fit = int(np.searchsorted(total[i + 1 :] - total[i], self.limit - self.used, side="right"))
            found[i : i + fit] = self.part
            self.used += int(total[i + fit] - total[i])
            i += fit
            if i < len(pos):
                self.part, self.used = self.part + 1, int(c[i])
                found[i] = self.part
                i += 1
        return found
