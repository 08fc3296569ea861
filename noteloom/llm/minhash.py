"""Near-duplicate classes by DartMinHash signatures and a banded join.

1. Each text becomes a weighted set of five-word shingles. Darts are thrown into the area under the
   weights: the plane (weight, rank) of an element is cut into dyadic cells, a cell's number of darts is
   Poisson with mean its area, seeded by element and cell, and a dart inside the element's weight and
   below the rank bound is kept. A dart's hash names a coordinate; the dart of least rank is that
   coordinate's value. Two sets agree in a coordinate with the probability of their weighted Jaccard
   similarity. The work is about the number of elements plus k log k, not their product.
2. Texts with the same words are one node. Bands of ``rows`` coordinates are bucket keys.
3. In each bucket the members are linked to leaders (least ids under two masks that differ by bucket);
   each node checks its ``TRIES`` most similar leaders. The shingle sets decide: similarity of
   0.8 or more is a link.
4. Components of these links are nearly the classes. Where a bucket still holds several
   components, pairs across components are compared by signature in blocks of bounded size (the members outside its largest
   component with that one and among themselves, so a large group costs a few copies of each member), and those
   that could reach the threshold are checked by their shingle sets in the same block, without a cap, in the
   first band that they share; only links leave the block. So every pair that shares a
   bucket is either linked, in one class already, or refuted.

Nothing is collected: nodes, links and labels stay in tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.llm.common import checkpointed, row_slices, rows_kept, staged, text_buffers
from noteloom.llm.graph import components
from noteloom.llm.textvec import mix64, row_hash, sequence_hash, shingles, span_hash, word_spans

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
BAND_BITS = 5
#: Leaders that each node checks before the search across components.
TRIES = 4
#: Signature similarity under which a pair is taken as refuted: five standard deviations below 0.8.
DOUBT = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5
#: Members of a bucket compared in one block with as many others.
BLOCK = 512


@lru_cache(maxsize=64)
def _poisson_cdf(mean: int) -> np.ndarray:
    n = int(mean + 12 * mean**0.5 + 24)
    log_p = np.arange(n) * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n)))])
    return np.cumsum(np.exp(log_p))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signature(h: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, k: int, seed: int = 1) -> np.ndarray:
    """Signatures (n_rows, k) of weighted sets given as elements (hash, row, weight > 0).

    Elements are distinct within a row. Rows without elements get zeros.
    """
    sig = np.zeros((n_rows, k), np.uint64)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    bound = np.zeros(n_rows)
    full = total > 0
    bound[full] = (k * np.log(k) + 2 * k) / total[full]
    todo = np.ones(len(h), bool)
    while todo.any():
        _throw(h[todo], row[todo], weight[todo], bound, sig, k, seed)
        lacking = full & (sig == 0).any(axis=1)
        sig[lacking] = 0
        bound[lacking] *= 2
        todo = lacking[row]
    return sig


def _throw(h, row, weight, bound, sig, k, seed) -> None:
    n_rows = len(bound)
    best = np.full(n_rows * k, np.inf)
    flat = sig.reshape(-1)
    limit = bound[row]
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    top = weight.max()
    nu = 0
    with np.errstate(over="ignore"):
        while 2.0**nu - 1 < top:
            wide = np.flatnonzero(weight > 2.0**nu - 1)
            rho = 0
            while len(wide):
                low = (2.0**rho - 1) / 2.0**nu
                wide = wide[limit[wide] > low]
                if not len(wide):
                    break
                cell = np.uint64((seed * 1_000_003 + nu * 1009 + rho + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                base = mix64(h[wide] ^ cell)
                count = np.searchsorted(_poisson_cdf(2**rho), _unit(base), side="right")
                owner = np.repeat(wide, count)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                dart = mix64(np.repeat(base, count) + (step.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
                rank = low + _unit(mix64(dart ^ np.uint64(0xA24BAED4963EE407))) * 2.0 ** (rho - nu)
                ok = rank < limit[owner]
                if nu or top != 1 or weight.min() < 1:
                    ok &= 2.0**nu - 1 + 2.0**nu * _unit(mix64(dart ^ np.uint64(0x9FB21C651E98DF25))) < weight[owner]
                ok = np.flatnonzero(ok)
                spot = row[owner[ok]] * k + (dart[ok] % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, spot, rank[ok])
                kept.append((spot, rank[ok], dart[ok] | np.uint64(1)))
                rho += 1
            nu += 1
    for spot, rank, dart in kept:
        first = rank == best[spot]
        flat[spot[first]] = dart[first]


def band_keys(small: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) bucket keys of signatures of a byte for each coordinate; a key's lowest bits are the band's number.

    Two texts share a bucket where the bytes of a band agree, so their signatures tell which buckets they share.
    """
    if bands > 1 << BAND_BITS:
        raise ValueError(f"at most {1 << BAND_BITS} bands")
    band = np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros((len(small), bands), np.uint64)
        for r in range(rows):
            out = mix64(out + small[:, r::rows][:, :bands] + np.uint64(r + 1))
        out = mix64(out + (band + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (out >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | band).view(np.int64)


def _weigh(h: np.ndarray, row: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row, weight) of a slice's shingles."""
    key = row_hash(mix64(h), row)
    order = np.argsort(key)
    k = key[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(first)
    pick = order[at]
    count = np.diff(np.append(at, len(k))).astype(np.float64)
    return h[pick], row[pick], count if weighting == "count" else np.ones(len(pick))


def signatures(docs: DataFrame, carried: list[str], weighting: str = "set", bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """The ``carried`` columns with f1, f2 (hash of the word sequence), bands and sig (a byte for each coordinate).

    Texts without words have null bands and sig.
    """
    src = docs.select(F.col("text").cast("string").alias("__text"), *carried)
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for lo, hi in row_slices(offs):
                n = hi - lo
                part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, row = word_spans(part, at)
                words = span_hash(part, starts, ends)
                f1, f2 = sequence_hash(words, row, n)
                h, owner = shingles(words, row, n, shingle)
                eh, erow, weight = _weigh(h, owner, weighting)
                sig = dart_signature(eh, erow, weight, n, k)
                small = (mix64(sig) >> np.uint64(56)).astype(np.uint8)
                keys = band_keys(small, bands, rows)
                empty = np.bincount(erow, minlength=n) == 0
                cols = [batch.column(i + 1).slice(lo, n) for i in range(len(carried))]
                cols += [
                    pa.array(f1.view(np.int64)),
                    pa.array(f2.view(np.int64)),
                    pa.array([None if e else x for e, x in zip(empty, keys, strict=True)], pa.list_(pa.int64())),
                    pa.array([None if e else x.tobytes() for e, x in zip(empty, small, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[*carried, "f1", "f2", "bands", "sig"])

    own = [T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    return src.mapInArrow(run, T.StructType([*src.schema.fields[1:], *own]))


def _with_elements(weighting: str, shingle: int = SHINGLE):
    """Batches (nid, sig, text) to (nid, sig, elements, size): 32-bit shingle hashes, sorted, repeated if they count."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for lo, hi in row_slices(offs):
                n = hi - lo
                part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, row = word_spans(part, at)
                h, owner = shingles(span_hash(part, starts, ends), row, n, shingle)
                eh, erow, weight = _weigh(h, owner, weighting)
                times = weight.astype(np.int64)
                both = np.sort((np.repeat(erow, times).astype(np.uint64) << np.uint64(32)) | np.repeat(eh, times).astype(np.uint32))
                cut = np.searchsorted(both >> np.uint64(32), np.arange(n + 1))
                sets = both.astype(np.uint32)
                packed = [sets[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                cols = [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(packed, pa.binary()), pa.array(np.diff(cut))]
                yield pa.RecordBatch.from_arrays(cols, names=["nid", "sig", "elements", "size"])

    return then


_PAYLOAD = T.StructType([T.StructField("nid", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("elements", T.BinaryType()), T.StructField("size", T.LongType())])


def set_similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted multisets of 32-bit hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if len(x) > 1 and (x[1:] == x[:-1]).any() or len(y) > 1 and (y[1:] == y[:-1]).any():
        xv, xc = np.unique(x, return_counts=True)
        yv, yc = np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(xv, yv, assume_unique=True, return_indices=True)
        common = int(np.minimum(xc[i], yc[j]).sum())
    else:
        common = int(np.isin(x, y, assume_unique=True).sum())
    return common / (len(x) + len(y) - common)


def _estimate(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, est) for pairs whose signatures don't refute the threshold."""
    left = pairs.join(sigs.select(F.col("nid").alias("a"), F.col("sig").alias("sa")), "a")
    joined = left.join(sigs.select(F.col("nid").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, -1) for i in (2, 3))
            est = (sa == sb).mean(axis=1)
            ok = est >= DOUBT
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(est[ok])], names=["a", "b", "est"])

    return joined.mapInArrow(run, "a long, b long, est double")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold."""
    left = pairs.select("a", "b").join(sets.select(F.col("nid").alias("a"), F.col("elements").alias("ea")), "a")
    joined = left.join(sets.select(F.col("nid").alias("b"), F.col("elements").alias("eb")), "b").select("a", "b", "ea", "eb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ea, eb = batch.column(2), batch.column(3)
            ok = [set_similarity(x.as_buffer(), y.as_buffer()) >= THRESHOLD for x, y in zip(ea, eb, strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _occurrences(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Elements of sorted multisets as (hash, which of its like), so a multiset's similarity is that of a set."""
    at = np.arange(len(sets))
    new = np.ones(len(sets), bool)
    new[1:] = sets[1:] != sets[:-1]
    new[offs[:-1][np.diff(offs) > 0]] = True
    return sets.astype(np.uint64) << np.uint64(32) | (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)


def _alike(elements: np.ndarray, offs: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` reach the threshold with ``one``; row r's elements are ``elements[offs[r] : offs[r + 1]]``, sorted, one at least."""
    mine = elements[offs[one] : offs[one + 1]]
    n = offs[others + 1] - offs[others]
    ends = np.cumsum(n)
    theirs = elements[np.arange(ends[-1]) + np.repeat(offs[others] - (ends - n), n)]
    hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
    common = np.add.reduceat(hit.astype(np.int64), ends - n)
    return common / (len(mine) + n - common) >= THRESHOLD


def _block_links(cell: dict[str, np.ndarray]) -> tuple[list[int], list[int]]:
    """Links across components in one cell of a bucket; after the first between two components, the
    others between these two add nothing and are not looked for.

    Texts of two components are compared in each bucket that they share, so they are left to the one of the first band.
    """
    nid, comp, size, side = (cell[k] for k in ("nid", "comp", "size", "side"))
    cross = cell["j"][0] < 0  # between the bucket's base and other members, so each pair is in one cell only
    band = int(cell["key"][0]) & (1 << BAND_BITS) - 1
    sig = np.frombuffer(b"".join(cell["sig"]), np.uint8).reshape(len(nid), -1)
    packed = np.zeros((len(nid), band), np.uint64)  # of each band before this one
    for r in range(ROWS):
        packed = packed << np.uint64(8) | sig[:, r::ROWS][:, :band]
    packed = np.asfortranarray(packed)
    sets = np.frombuffer(b"".join(cell["elements"]), np.uint32)
    offs = np.concatenate([[0], np.cumsum([len(e) // 4 for e in cell["elements"]])])
    elements = _occurrences(sets, offs)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    a_out, b_out = [], []
    lefts = np.flatnonzero(side <= 0)
    rights = np.flatnonzero(side != 0) if (side > 0).any() else lefts
    if not len(rights):
        return a_out, b_out
    rsig, rcomp, rsize, rnid, rpacked = sig[rights], comp[rights], size[rights], nid[rights], np.asfortranarray(packed[rights])
    for i in lefts:
        fit = (rcomp != comp[i]) & (cross | (rnid > nid[i])) & (np.minimum(rsize, size[i]) >= THRESHOLD * np.maximum(rsize, size[i]))
        for b in range(band):
            if not fit.any():
                break
            fit &= rpacked[:, b] != packed[i, b]
        near = np.flatnonzero(fit)
        if not len(near):
            continue
        est = (rsig[near] == sig[i]).mean(axis=1)
        near, est = near[est >= DOUBT], est[est >= DOUBT]
        near = near[np.argsort(-est)]
        lo, step = 0, 4
        while lo < len(near):
            some = near[lo : lo + step]
            lo, step = lo + step, step * 4
            if root:
                own = find(int(comp[i]))
                some = some[[find(int(c)) != own for c in rcomp[some]]]
            for j in some[_alike(elements, offs, i, rights[some])] if len(some) else ():
                x, y = find(int(comp[i])), find(int(rcomp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a_out.append(min(int(nid[i]), int(rnid[j])))
                    b_out.append(max(int(nid[i]), int(rnid[j])))
    return a_out, b_out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_block_links`` of each cell; rows come sorted by cell, and a cell may go on in the next batch."""
    names = ["key", "i", "j", "side", "nid", "comp", "size", "sig", "elements"]
    rest: pa.Table | None = None

    def links(part: pa.Table) -> pa.RecordBatch:
        key = np.stack([part.column(k).to_numpy().astype(np.int64) for k in ("key", "i", "j")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        cols = {k: part.column(k).to_numpy() for k in ("key", "nid", "comp", "size", "side", "j")} | {k: np.array(part.column(k).to_pylist() + [None], object)[:-1] for k in ("sig", "elements")}
        a_all, b_all = [], []
        for lo, hi in zip([0, *cuts], [*cuts, part.num_rows], strict=True):
            if hi - lo > 1:
                a, b = _block_links({k: v[lo:hi] for k, v in cols.items()})
                a_all += a
                b_all += b
        return pa.RecordBatch.from_arrays([pa.array(a_all, pa.int64()), pa.array(b_all, pa.int64())], names=["a", "b"])

    for batch in batches:
        got = pa.Table.from_batches([batch]).select(names)
        rest = pa.concat_tables([rest, got]) if rest is not None else got
        last = [rest.column(k)[-1].as_py() for k in ("key", "i", "j")] if rest.num_rows else None
        if last is None:
            continue
        same = np.logical_and.reduce([rest.column(k).to_numpy() == v for k, v in zip(("key", "i", "j"), last, strict=True)])
        begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if begin:
            yield links(rest.slice(0, begin))
            rest = rest.slice(begin).combine_chunks()
    if rest is not None and rest.num_rows:
        yield links(rest)


def _links(table: DataFrame, ids: DataFrame, weighting: str) -> DataFrame:
    """(a, b): links between the nodes ``ids`` (nid) of ``table`` that make up the classes.

    Only nodes that share a bucket get their shingle sets made, from the texts in the staged table.
    """
    banded = checkpointed(table.where("bands IS NOT NULL").select(F.col("__uid").alias("nid"), "bands").join(ids, "nid", "left_semi"))
    spread = banded.select("nid", F.explode("bands").alias("key"))
    masks = [F.xxhash64(F.col("key"), F.lit(s)) for s in (11, 12)]
    leaders = checkpointed(
        spread.groupBy("key")
        .agg(F.count("*").alias("n"), *[F.min(F.col("nid").bitwiseXOR(m)).alias(f"m{i}") for i, m in enumerate(masks)])
        .where("n > 1")
        .select("key", *[F.col(f"m{i}").bitwiseXOR(m).alias(f"l{i}") for i, m in enumerate(masks)])
    )
    inside = staged(spread.join(leaders, "key"), "buckets")
    shared = inside.select(F.col("nid").alias("__uid")).distinct()
    payload = staged(rows_kept(table, shared, [F.col("__uid").alias("nid"), F.col("sig"), F.col("__row.text").cast("string").alias("text")], _with_elements(weighting), _PAYLOAD), "payload")
    seats = checkpointed(inside.select(F.col("nid").alias("a"), F.explode(F.array("l0", "l1")).alias("b")).where("a <> b").distinct())
    best = _estimate(seats, payload).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("est", "b")), asc=False), 1, TRIES).alias("top"))
    tried = best.select("a", F.explode("top.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = checkpointed(_verified(checkpointed(tried), payload))
    comps = components(links).withColumnRenamed("node", "nid")

    member = checkpointed(inside.select("nid", "key").join(comps, "nid", "left").select("key", "nid", F.coalesce("comp", "nid").alias("comp")))
    # the largest component of a bucket is its base: only other members are compared among themselves, and with it
    sized = checkpointed(member.groupBy("key", "comp").agg(F.count("*").alias("n")))
    mixed = sized.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n")).where("comps > 1")
    seen = checkpointed(member.join(checkpointed(mixed.select("key", F.col("top.comp").alias("base"), F.col("top.n").alias("n_base"), (F.col("n") - F.col("top.n")).alias("n_rest"))), "key"))
    cut = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    full = seen.join(payload, "nid").withColumn("b_base", cut("n_base")).withColumn("b_rest", cut("n_rest"))
    own = lambda blocks: F.pmod(F.xxhash64("nid"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    rest = ["nid", "comp", "size", "sig", "elements"]
    based, others = full.where("comp = base"), full.where("comp <> base")
    cells = based.select("key", own("b_base").alias("i"), every("b_rest").alias("o"), F.lit(1).alias("side"), *rest).withColumn("j", -1 - F.col("o"))
    cells = cells.unionByName(others.select("key", every("b_base").alias("i"), own("b_rest").alias("o"), F.lit(0).alias("side"), *rest).withColumn("j", -1 - F.col("o"))).drop("o")
    alone = others.where("b_rest = 1 AND n_rest > 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"), *rest)
    left = others.where("b_rest > 1").select("key", own("b_rest").alias("i"), every("b_rest").alias("j"), F.lit(0).alias("side"), *rest)
    right = others.where("b_rest > 1").select("key", every("b_rest").alias("i"), own("b_rest").alias("j"), F.lit(1).alias("side"), *rest)
    # the work follows the pairs, not the bytes, so the partitions aren't merged by size
    width = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.unionByName(alone).unionByName(left).unionByName(right).repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return links.union(cells.mapInArrow(_across, "a long, b long"))


def _classed(docs: DataFrame, weighting: str) -> tuple[DataFrame, DataFrame]:
    """(table, rows): the staged documents (__row, __uid, ...) and for each __uid its class.

    ``rows`` has __uid, doc_id, class_id and kept; the texts stay in the table.
    """
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    src = docs.select(struct, F.col("text"), F.col("doc_id").cast("long").alias("__id"))
    table = staged(signatures(src, ["__row", "__id"], weighting).withColumn("__uid", F.monotonically_increasing_id()), "signatures")
    exact = checkpointed(
        table.groupBy("f1", "f2").agg(
            F.min("__uid").alias("nid"), F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__uid").alias("uid"))).alias("head")
        )
    )
    comps = components(_links(table, exact.select("nid"), weighting))
    placed = checkpointed(exact.join(comps.withColumnRenamed("node", "nid"), "nid", "left").select("f1", "f2", F.coalesce("comp", "nid").alias("comp"), "head"))
    heads = checkpointed(placed.groupBy("comp").agg(F.min("head").alias("best")))
    known = checkpointed(placed.join(heads, "comp").select("f1", "f2", F.col("best.id").alias("class_id"), F.col("best.uid").alias("stays")))
    rows = table.select("__uid", F.col("__id").alias("doc_id"), "f1", "f2").join(known, ["f1", "f2"])
    return table, rows.select("__uid", "doc_id", "class_id", (F.col("__uid") == F.col("stays")).alias("kept"))


def near_duplicates(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """doc_id, class_id and kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    A class holds texts linked by a shingle similarity of 0.8 or more, directly or through others: with weighting 'count' a
    shingle weighs as often as it occurs, and the similarity is the weighted Jaccard one, of signature and check alike; with
    'set' each counts once;
    class_id is its least doc_id, and ``kept`` marks one row of it, with that doc_id. Texts of 1 to 4 words
    have one shingle, all their words. Texts without words (null, empty, blank) are one class. Repeated
    rows and rows with the same words are in one class. A null doc_id sorts last; a class of
    null ids has a null class_id and still keeps one row. Texts may be of any length, and an empty table gives an empty
    result.
    """
    _, rows = _classed(docs.select("doc_id", "text"), weighting)
    return rows.select("doc_id", "class_id", "kept")


def deduplicate(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """One row of each class of ``near_duplicates``, all columns of ``docs`` unchanged."""
    table, rows = _classed(docs, weighting)
    return rows_kept(table, rows.where("kept").select("__uid"), [F.col("__row")]).select("__row.*")
