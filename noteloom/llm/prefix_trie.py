"""Prefix trie of conversations, built level by level.

A conversation is first rebuilt: its first turns are those of the conversation it was branched from. A node of depth d stands for the
conversations whose first d turns are equal; it is named by the least of them. For each depth the live conversations, those in a
node with others, are grouped by (node, next turn), which gives the nodes of the next depth; then, from the deepest level
up, joins add up leaves and saved tokens.

A conversation that is alone in its node stays alone, so the rest of its path is written out at once, without further
rounds: there are as many rounds as the longest prefix that two conversations share. Turns travel as hashes
of 256 bits and word counts. Turns are numbered and the ids of large nodes are hashed by ranges, so no conversation and no node meets in
one task; joins with a node that holds much of the table are left to Spark to split. The driver sees a count for
each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import new_dir, placed, staged
from noteloom.llm.merkle import crc32_sql

#: Conversations are branched in blocks of this many, from the first of their block, and keep fewer than ``KEPT`` of its turns.
BRANCHES, KEPT = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Ids in one piece of a node's list.
PIECE = 1024
_NONE = hashlib.sha256(b"").hexdigest()
OUTPUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def kept_turns(conv: Column) -> Column:
    """How many turns a conversation has from the one it was branched from."""
    return (F.crc32(conv.cast("string").cast("binary")) % KEPT).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, turns): (conv, len) of every conversation, and (conv, depth from 1, key, words, len) of its rebuilt turns."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    own = staged(placed(staged(rows, "trie-turns"), "conv", ["turn", "key"], "trie-order").select("conv", "key", "words", F.col("__pos").alias("pos"), F.col("__n").alias("n")), "trie-placed")
    first = own.where("pos = 0").select("conv", "n", (F.col("conv") - F.col("conv") % BRANCHES).alias("base"), kept_turns(F.col("conv")).alias("kept"))
    theirs = first.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    from_base = F.least("kept", F.coalesce("base_n", F.lit(0))).cast("long")
    convs = first.join(theirs, "base", "left").select("conv", "base", "kept", from_base.alias("given"), (from_base + F.greatest(F.col("n") - F.col("kept"), F.lit(0))).alias("len"))
    convs = staged(convs, "trie-convs")
    given = own.where(F.col("pos") < KEPT - 1).select(F.col("conv").alias("base"), "pos", "key", "words")
    given = convs.join(given, "base").where("pos < kept").select("conv", (F.col("pos") + 1).alias("depth"), "key", "words", "len")
    rest = own.join(convs, "conv").where("pos >= kept").select("conv", (F.col("given") + F.col("pos") - F.col("kept") + 1).alias("depth"), "key", "words", "len")
    return convs.select("conv", "len"), given.union(rest)


def _band(depth: Column | int):
    """The folder of a depth: one for each of the first 16, then one for each doubling."""
    if isinstance(depth, int):
        return depth if depth <= 16 else 12 + (depth - 1).bit_length()
    return F.when(depth <= 16, depth).otherwise(F.lit(12) + F.length(F.bin(depth - 1))).cast("int")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for every node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Reads conv_id, turn, role and text. Rows without a conv_id belong to no conversation and are left out; turns without a number
    come first; a null role or text is an empty one; turns of one number are ordered by the hash of role and text, so repeated rows are turns
    of their own. Texts of any length count whole. A conversation whose turns are all replaced by none is a member of the root
    alone. Without conversations there are no nodes, not even a root. Other columns, whatever their names, aren't read.
    """
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations)
    place = new_dir(spark, "trie-rebuilt")
    turns.withColumn("band", _band(F.col("depth"))).write.partitionBy("band").parquet(place)
    turns = spark.read.schema("conv long, depth long, key binary, words long, len long, band int").parquet(place)
    root, n = convs.agg(F.min("conv"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    kind = "depth long, id long, parent long, n long, words long"
    levels = [spark.createDataFrame([(0, root, None, n, 0)], kind)]
    ends = [convs.where("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("id"), "conv")]
    live, depth = None, 0
    while live is None or live.limit(1).count():
        depth += 1
        here = turns.where((F.col("band") == _band(depth)) & (F.col("depth") == depth)).select("conv", "key", "words", "len")
        asked = here.withColumn("node", F.lit(root).cast("long")) if live is None else here.join(live.select("conv", "node"), "conv")
        asked = staged(asked.select("node", "key", "conv", "words", "len"), "trie-next")
        groups = staged(asked.groupBy("node", "key").agg(F.min("conv").alias("id"), F.count("*").alias("n"), F.max("words").alias("words")), "trie-level")
        shared = groups.where("n > 1").select("node", "key", "id")
        live = staged(asked.join(shared, ["node", "key"]).select("conv", F.col("id").alias("node"), "len"), "trie-live")
        levels.append(groups.select(F.lit(depth).cast("long").alias("depth"), "id", F.col("node").alias("parent"), "n", "words"))
        ends.append(live.where(F.col("len") == depth).select(F.lit(depth).cast("long").alias("depth"), F.col("node").alias("id"), "conv"))

    together = _rolled_up(levels)
    hashes = ends_digests(_union(ends))
    shared = together.join(hashes, ["depth", "id"], "left").select(
        F.col("id").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(_NONE)).alias("ends_sha256")
    )
    # nodes of one conversation, from where it leaves the others to its end
    starts = _union([level.where("n = 1").select(F.col("id").alias("conv"), F.col("depth").alias("start"), "parent") for level in levels[1:]])
    tails = turns.select("conv", "depth", "len").join(starts, "conv").where("depth >= start")
    last = F.col("depth") == F.col("len")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = tails.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NONE)).alias("ends_sha256"),
    )
    return shared.union(alone)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _rolled_up(levels: list[DataFrame]) -> DataFrame:
    """Nodes of several conversations, and the root, with n_children, n_leaves and saved_tokens; from the deepest level up."""
    below, done = None, []
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        here = level.where("n > 1 OR depth = 0")
        own = (F.col("n") - 1) * F.col("words")
        if below is None:
            made = here.select("*", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), own.alias("saved_tokens"))
        else:
            found = here.join(below, "id", "left")
            made = found.select("depth", "id", "parent", "n", "words", F.coalesce("c", F.lit(0)).alias("n_children"), F.coalesce("l", F.lit(1)).alias("n_leaves"), (own + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        made = staged(made, "trie-rolled")
        done.append(made)
        single = level.where("n = 1 AND depth > 0").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        every = made.select("parent", "n_leaves", "saved_tokens").union(single)
        below = every.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    return _union(done)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, id, sha): SHA-256 of the ids (depth, id, conv) of each node, ascending, joined by commas.

    Ranges of the sorted ids are joined to pieces in parallel; a digest, which hangs on all before it, reads its node's pieces as a stream.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, node, conv = (batch.column(i).to_numpy() for i in range(3))
            fresh = np.flatnonzero((depth[1:] != depth[:-1]) | (node[1:] != node[:-1])) + 1
            cuts = np.unique(np.concatenate([fresh, np.arange(0, len(conv), PIECE), [len(conv)]]))
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at = cuts[:-1]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(depth[at]), pa.array(node[at]), pa.array(conv[at]), pa.array(text)], names=["depth", "id", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "id", "ids")), strict=True):
                if (depth, node) != now:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (depth, node), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(done) >= 10_000:
                yield _listed(done)
                done = []
        if now:
            done.append((*now, sha.hexdigest()))
        if done:
            yield _listed(done)

    ranged = staged(ends, "trie-ends").repartitionByRange("depth", "id", "conv").sortWithinPartitions("depth", "id", "conv")
    cut = ranged.mapInArrow(pieces, "depth long, id long, first long, ids string")
    return cut.repartition("depth", "id").sortWithinPartitions("depth", "id", "first").mapInArrow(digests, "depth long, id long, sha string")


def _listed(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, node, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(sha)], names=["depth", "id", "sha"])


def oracle_sql() -> str:
    """Nodes as the distinct prefixes of rebuilt conversations, each written as the digests of its turns in a row."""
    key = "sha256(strlen(role) || ':' || role || text)"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT conv_id, {key} AS key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {key}) - 1 AS pos FROM t),
        c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % {BRANCHES} AS base, {crc32_sql("conv_id::VARCHAR")} % {KEPT} AS h FROM k GROUP BY conv_id),
        i AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS given FROM c LEFT JOIN c b ON b.conv_id = c.base),
        r AS (SELECT i.conv_id, pos + 1 AS depth, key, words FROM i JOIN k ON k.conv_id = i.base AND pos < h UNION ALL SELECT conv_id, given + pos - h + 1, key, words FROM i JOIN k USING (conv_id) WHERE pos >= h),
        q AS (SELECT conv_id, depth, words, string_agg(key, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM i),
        e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM q),
        nodes AS (SELECT depth, path, min(conv_id) AS id, count(*) AS n, max(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends FROM e GROUP BY depth, path),
        up AS (SELECT depth - 1 AS depth, substr(path, 1, 64 * (depth - 1)) AS path, count(*) AS children FROM nodes WHERE depth > 0 GROUP BY ALL),
        f AS (SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN up USING (depth, path)),
        s AS (SELECT a AS depth, substr(path, 1, 64 * a) AS path, sum((children = 0)::INT) AS leaves, sum((n - 1) * words) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM f) GROUP BY ALL)
        SELECT f.id AS conv_id, f.depth::BIGINT AS depth, p.id AS parent_conv_id, f.n AS n_convs, f.children AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
        FROM f JOIN s USING (depth, path) LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.path = substr(f.path, 1, 64 * (f.depth - 1))"""
