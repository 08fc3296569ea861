"""Merkle manifest of a table: a digest for every row, one root, and a proof for each row.

A row's leaf is the SHA-256 of its fields. The leaves of a source, ordered by id, are hashed in runs of 16, and so on until
one node is left; these nodes, ordered by source, are hashed the same way to the root. Digests are lower-case hex text.

Places come from ``placed``, so a source of any size is spread over tasks. The tree is cut into aligned blocks of 16**3 nodes,
whose rows Arrow brings into a DuckDB of the task: three queries of ``string_agg`` in order and ``sha256`` make a block's
root. The roots of a source's blocks are the nodes of the next layer, dealt into blocks again; 4096**k rows need k
layers. On the way down a block's path (what stands left and right of it at each level above) is found by the same blocks,
and travels to the rows as one more row of their block, never once a row. The driver sees the largest number of
nodes in a group, once a layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.llm.common import placed, staged

ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
#: Characters of a digest.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a task hands to DuckDB at once, and the memory that it may use.
CHUNK, MEMORY = 16 * BLOCK, "400MB"
_PATH = "lefts array<string>, rights array<string>, tops array<string>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """A field as it is hashed: '-' if null, else its UTF-8 bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _group(source: Column) -> Column:
    """A source as a key that isn't null: null first, others in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, with ``b``, the block's number in the chunk; rows come in the order of (grp, block)."""
    held: list[pa.RecordBatch] = []

    def changes(table: pa.Table) -> np.ndarray:
        fresh = np.zeros(len(table), bool)
        if len(table) > 1:
            for name in ("grp", "block"):
                c = table.column(name).combine_chunks()
                fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return fresh

    def numbered(table: pa.Table, fresh: np.ndarray) -> pa.Table:
        return table.append_column("b", pa.array(np.cumsum(fresh), pa.int64()))

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            table = pa.Table.from_batches(held)
            fresh = changes(table)
            cut = int(np.flatnonzero(fresh)[-1])  # a block has BLOCK nodes and a path at most
            yield numbered(table.slice(0, cut), fresh[:cut])
            held = table.slice(cut).to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield numbered(table, changes(table))


def _levels(con) -> None:
    """l0 to l3, the nodes (b, i, steps, h) of each level, and r0 to r2, the runs (b, r, s) that they form."""
    con.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT b, i, steps, h FROM block_rows WHERE i >= 0")
    for k in range(LEVELS):
        con.execute(f"CREATE OR REPLACE TEMP TABLE r{k} AS SELECT b, i // {ARITY} AS r, any_value(steps) AS steps, string_agg(h, '' ORDER BY i) AS s FROM l{k} WHERE steps > {k} GROUP BY b, i // {ARITY}")
        con.execute(f"CREATE OR REPLACE TEMP TABLE l{k + 1} AS SELECT b, r AS i, steps, sha256(s) AS h FROM r{k}")


def _sides(name: str) -> str:
    """SQL of what stands left or right of a row at each level of its block, as a list of up to LEVELS texts."""
    parts = []
    for k in range(LEVELS):
        at = f"(n.i // {ARITY**k} % {ARITY})"
        cut = f"substr(r{k}.s, 1, {DIGEST} * {at})" if name == "left" else f"substr(r{k}.s, {DIGEST} * {at} + {DIGEST + 1})"
        parts.append(f"CASE WHEN n.steps > {k} THEN [{cut}] ELSE [] END")
    return " || ".join(parts)


_JOINED = "FROM block_rows n " + " ".join(f"LEFT JOIN r{k} ON r{k}.b = n.b AND r{k}.r = n.i // {ARITY ** (k + 1)}" for k in range(LEVELS))


def _roots_sql(depth: int) -> str:
    top = " UNION ALL ".join(f"SELECT b, h FROM l{k} WHERE steps = {k}" for k in range(LEVELS + 1))
    return f"SELECT n.grp, n.block, n.n, t.h FROM block_rows n JOIN ({top}) t USING (b) WHERE n.i = 0"


def _paths_sql(own: bool):
    def sql(depth: int) -> str:
        tops = "list_prepend(n.h, p.tops)" if own else "p.tops"
        return f"""SELECT n.key AS grp, n.at AS block, {_sides("left")} || p.lefts AS lefts, {_sides("right")} || p.rights AS rights, {tops} AS tops
            {_JOINED} JOIN (SELECT b, lefts, rights, tops FROM block_rows WHERE i < 0) p ON p.b = n.b WHERE n.i >= 0"""

    return sql


def _proofs_sql(depth: int) -> str:
    """``depth``: levels above the blocks, at most. The siblings of a level are what stands left, then what stands right."""
    proof = " || ".join(f"CASE WHEN steps > {k} THEN lo{k} || hi{k} ELSE '' END" for k in range(LEVELS))
    inner = ", ".join(f"substr(r{k}.s, 1, {DIGEST} * (n.i // {ARITY**k} % {ARITY})) AS lo{k}, substr(r{k}.s, {DIGEST} * (n.i // {ARITY**k} % {ARITY}) + {DIGEST + 1}) AS hi{k}" for k in range(LEVELS))
    sql = f"SELECT n.doc_id, n.h AS leaf, n.alt, n.steps, p.lefts, p.rights, p.above, p.tops, {inner} {_JOINED} JOIN paths p ON p.b = n.b WHERE n.i >= 0"
    sql = f"SELECT *, sha256({proof} || above) AS proof_sha256, coalesce(alt, leaf) AS f FROM ({sql})"
    for k in range(LEVELS):
        sql = f"SELECT * REPLACE (CASE WHEN steps > {k} THEN sha256(lo{k} || f || hi{k}) ELSE f END AS f) FROM ({sql})"
    for k in range(1, depth + 1):
        sql = f"SELECT * REPLACE (CASE WHEN len(lefts) >= {k} THEN sha256(lefts[{k}] || f || rights[{k}]) ELSE f END AS f) FROM ({sql})"
    return f"SELECT doc_id, leaf, tops[1] AS subroot, tops[2] AS root, proof_sha256, f AS folded_root FROM ({sql})"


def _in_blocks(rows: DataFrame, sql, schema: str | T.StructType) -> DataFrame:
    """What a query makes of ``block_rows``, in a DuckDB of each task; rows are dealt by block."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    dealt = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        for chunk in _chunks(batches):
            con.register("block_rows", chunk)
            _levels(con)
            depth = 0
            if "lefts" in chunk.column_names:
                # what a block's path adds to a proof is put together once a block
                con.execute("CREATE OR REPLACE TEMP TABLE paths AS SELECT b, lefts, rights, tops, list_reduce(list_prepend('', list_transform(list_zip(lefts, rights), lambda z: z[1] || z[2])), lambda a, x: a || x) AS above FROM block_rows WHERE i < 0")
                depth = con.execute("SELECT coalesce(max(len(lefts)), 0) FROM paths").fetchall()[0][0]
            made = con.sql(sql(depth)).to_arrow_table()
            con.unregister("block_rows")
            yield from made.select(kinds.names).cast(kinds).to_batches(max_chunksize=BLOCK)

    return dealt.mapInArrow(run, out)


def _rows(nodes: DataFrame, *more: str) -> DataFrame:
    n = F.col("n")
    steps = F.when(n <= 1, 0).when(n <= ARITY, 1).when(n <= ARITY**2, 2).otherwise(LEVELS)
    return nodes.select("grp", F.expr(f"pos div {BLOCK}").alias("block"), (F.col("pos") % BLOCK).alias("i"), "n", steps.cast("long").alias("steps"), "h", *more)


def _with_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    ours = paths.select("grp", "block", F.lit(-1).cast("long").alias("i"), "lefts", "rights", "tops")
    return rows.unionByName(ours, allowMissingColumns=True)


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(layers, tops): the nodes (grp, pos, n, h, ...) of each layer, and the last node (grp, h) of every group."""
    layers = [nodes]
    while True:
        most = layers[-1].agg(F.max("n")).first()[0] or 0
        roots = staged(_in_blocks(_rows(layers[-1]), _roots_sql, "grp string, block long, n long, h string"), "merkle-roots")
        if most <= BLOCK:
            return layers, roots.select("grp", "h")
        layers.append(roots.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), "h", F.col("grp").alias("key"), F.col("block").alias("at")))


def _descend(layers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths (grp, block, lefts, rights, tops) of the first layer's blocks, from those of the last one's."""
    for layer in reversed(layers[1:]):
        paths = staged(_in_blocks(_with_paths(_rows(layer, "key", "at"), paths), _paths_sql(False), f"grp string, block long, {_PATH}"), "merkle-paths")
    return paths


def manifest(docs: DataFrame, tamper: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    ``fields`` names the id, the source and further fields of a row, the last of which is a text. Where ``tamper`` holds, the row is
    checked with its text's A-Z lower-cased: ``folded_root`` is recomputed from that leaf and the siblings of the
    untampered tree, ``verified`` says whether it is the root. The proof is the siblings of all levels, left to right.

    Nulls are hashed as such: a null source is a source of its own, the first; null ids come first in their source. Rows of one
    id are ordered by leaf, so repeated rows are leaves of their own, in a definite tree. Empty and very long texts
    are hashed whole. An empty table has no rows and no root. Other columns, whatever their names, aren't read.
    """
    doc_id, source, *rest = [F.col(f"`{c}`") for c in fields]
    text = F.translate(rest[-1], UPPER, UPPER.lower())
    alt = F.when(F.coalesce(tamper, F.lit(False)) & (text != rest[-1]), leaf([doc_id, source, *rest[:-1], text])) if tamper is not None else F.lit(None).cast("string")
    slim = staged(docs.select(doc_id.alias("doc_id"), _group(source).alias("grp"), leaf([doc_id, source, *rest]).alias("h"), alt.alias("alt")), "merkle-leaves")
    leaves = staged(placed(slim, "grp", ["doc_id", "h"], "merkle-order").select("grp", F.col("__pos").alias("pos"), F.col("__n").alias("n"), "h", "alt", "doc_id"), "merkle-placed")
    inner, subroots = _climb(leaves)
    sources = placed(subroots.select(F.lit("").alias("one"), F.col("grp").alias("key"), "h"), "one", ["key"], "merkle-sources")
    outer, tops = _climb(staged(sources.select(F.col("one").alias("grp"), F.col("__pos").alias("pos"), F.col("__n").alias("n"), "h", "key", F.lit(0).cast("long").alias("at")), "merkle-subroots"))
    none = F.array().cast("array<string>")
    paths = _descend(outer, tops.select("grp", F.lit(0).cast("long").alias("block"), none.alias("lefts"), none.alias("rights"), F.array("h").alias("tops")))
    paths = staged(_in_blocks(_with_paths(_rows(outer[0], "key", "at"), paths), _paths_sql(True), f"grp string, block long, {_PATH}"), "merkle-paths")
    paths = _descend(inner, paths)
    kind = T.StructType([T.StructField("doc_id", slim.schema["doc_id"].dataType), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])
    proofs = _in_blocks(_with_paths(_rows(leaves, "alt", "doc_id"), paths), _proofs_sql, kind)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def marked(doc_id: Column) -> Column:
    """Rows of the query that are tampered with."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def crc32_sql(text: str) -> str:
    """DuckDB SQL of an unsigned CRC-32 of ASCII text."""
    step = "list_reduce(list_prepend(xor(c, o), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, o: {step}), 4294967295)"


def oracle_sql(depth: int = 7) -> str:
    """Both trees level by level, for up to 16**depth rows a source and as many sources."""
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    row = lambda text: " || ".join([*map(enc, FIELDS[:-1]), enc(text)])
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    ctes = [
        f"d AS MATERIALIZED (SELECT doc_id, source, sha256({row('text')}) AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN sha256({row(low)}) END AS alt FROM documents)",
        "t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "a0 AS (SELECT source, pos AS i, n, leaf AS h FROM t)",
    ]
    up = lambda name, k, by: [
        f"{name}r{k} AS MATERIALIZED (SELECT {by} i // 16 AS r, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY ALL)",
        f"{name}{k + 1} AS MATERIALIZED (SELECT {by} r AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}r{k})",
    ]
    for k in range(depth):
        ctes += up("a", k, "source,")
    ctes.append(f"b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, source FROM a{depth})")
    for k in range(depth):
        ctes += up("b", k, "")
    ctes.append("p0 AS (SELECT t.*, b0.i AS s, b0.n AS m, b0.h AS subroot, '' AS proof, coalesce(alt, leaf) AS f FROM t JOIN b0 ON b0.source IS NOT DISTINCT FROM t.source)")

    def down(frm: str, to: str, name: str, k: int, at: str, size: str, on: str) -> str:
        j = f"({at} // {16**k}) % 16"
        lo, hi = f"array_to_string(hs[1:{j}], '')", f"array_to_string(hs[{j} + 2:], '')"
        many = f"({size} + {16**k - 1}) // {16**k} > 1"
        return f"{to} AS (SELECT p.* REPLACE (CASE WHEN {many} THEN proof || {lo} || {hi} ELSE proof END AS proof, CASE WHEN {many} THEN sha256({lo} || f || {hi}) ELSE f END AS f) FROM {frm} p JOIN {name}r{k} x ON {on} x.r = {at} // {16 ** (k + 1)})"

    at = 0
    for k in range(depth):
        ctes.append(down(f"p{at}", f"p{at + 1}", "a", k, "p.pos", "p.n", "x.source IS NOT DISTINCT FROM p.source AND"))
        at += 1
    for k in range(depth):
        ctes.append(down(f"p{at}", f"p{at + 1}", "b", k, "p.s", "p.m", ""))
        at += 1
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, b{depth}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{depth}.h AS verified FROM p{at}, b{depth}"
