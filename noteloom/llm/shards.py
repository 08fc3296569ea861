"""Training-order materialisation: token sequences in fixed-stride shards, permuted by a keyed Feistel network.

The documents' ids, each followed by the end id, form one stream in partition and row order. The
stream is cut into sequences of ``length`` ids. A permutation of 0..N-1 gives every sequence its global
slot: a balanced Feistel network on the next even number of bits, walked until it falls below N. Shard k
holds the slots k * per_shard and on, each ``length`` ids of ``width`` bytes, so a reader
finds slot i by one division and resumes from any slot.

The ids are made once and staged, compressed, as runs of consecutive ids; the driver sees a row for each
partition of them, which fixes N and every run's place in the stream. Then each run is cut at the sequence
boundaries, and the pieces go to the range partition of their slot.

A shard is written under a name of its own attempt and renamed, so a repeated task replaces the
file by an equal one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import staged
from noteloom.llm.sentencepieces import ChunkTable, check_model

LENGTH = 2048
PER_SHARD = 16_384
_ROUNDS = 6


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..n-1 at the places x."""
    half = max(1, (max(1, (n - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = [int.from_bytes(hashlib.sha256(f"{key}|{r}".encode()).digest()[:8], "little") for r in range(_ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        with np.errstate(over="ignore"):
            for k in rounds:
                f = (right ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(x, np.uint64))
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = once(out[beyond])
        beyond = beyond[out[beyond] >= n]
    return out.astype(np.int64)


def token_runs(docs: DataFrame, model_path: str) -> DataFrame:
    """(part, before, n, ids): compressed runs of ids, end ids included, and the ids of their partition before each."""
    check_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before, part = ChunkTable(model_path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, flat, at in table.encode_column(batch.column(0)):
                n = hi - lo
                out = np.empty(len(flat) + n, table.kind)
                ends = at[1:] + np.arange(n)
                body = np.ones(len(out), bool)
                body[ends] = False
                out[ends], out[body] = table.eos, flat
                packed = pa.Codec("zstd", compression_level=6).compress(out.tobytes(), asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(out)], pa.int64()), pa.array([packed], pa.binary())], names=["part", "before", "n", "ids"])
                before += len(out)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "part int, before long, n long, ids binary")


def sequences(docs: DataFrame, model_path: str, key: int, length: int = LENGTH) -> tuple[DataFrame, int]:
    """(fragments, N): rows (slot, seq, pos, ids) of compressed pieces; a sequence has one or, where it
    crosses runs, more of them, in the order of pos."""
    runs = staged(token_runs(docs, model_path), "token-runs")
    base, at = {}, 0
    for r in runs.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        base[r.part] = at
        at += r.n
    total = -(-at // length)
    width = ChunkTable(model_path, 1).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, n, ids in zip(*(batch.column(k).to_pylist() for k in ("part", "before", "n", "ids")), strict=True):
                data = pa.Codec("zstd").decompress(ids, decompressed_size=n * width, asbytes=True)
                start = base[part] + before
                cuts = np.unique(np.concatenate([[start], np.arange(-(-start // length) * length, start + n, length), [start + n]]))
                seq = cuts[:-1] // length
                pieces = [zlib.compress(data[(a - start) * width : (b - start) * width], 6) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                cols = [pa.array(feistel(seq, total, key)), pa.array(seq), pa.array((cuts[:-1] % length).astype(np.int32)), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["slot", "seq", "pos", "ids"])

    return runs.mapInArrow(run, "slot long, seq long, pos int, ids binary"), total


def write_shards(docs: DataFrame, model_path: str, out_dir: str, key: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards under ``out_dir`` (a URL that all executors reach) and list the sequences.

    Lazily: files are written when the result is evaluated. Returns seq, slot, shard, byte_offset, n_tokens
    and sha256 of the sequence's bytes, one row a sequence. Reads text only; null and empty texts are a lone
    end id each, repeated rows repeat. The last sequence is filled up with the end id. An empty table
    gives no sequence and no file.
    """
    parts, total = sequences(docs, model_path, key, length)
    n_shards = max(1, -(-total // per_shard))
    dealt = parts.withColumn("shard", F.expr(f"cast(slot div {per_shard} as int)")).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("slot", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out_dir)
        table = ChunkTable(model_path, 1)
        width, end = table.width, np.array([table.eos], table.kind).tobytes()
        attempt = TaskContext.get().taskAttemptId()
        sink = name = None
        open_slot, rows = None, []
        body = b""

        def close(shard: int) -> None:
            sink.close()
            store.move(f"{name}.{attempt}.part", name)

        def flush() -> None:
            n = len(body) // width
            data = body + end * (length - n)
            sink.write(data)
            rows.append((*open_slot, n, hashlib.sha256(data).hexdigest()))

        def listed() -> pa.RecordBatch:
            seq, slot, n, sha = zip(*rows, strict=True)
            shard = [s // per_shard for s in slot]
            offset = [s % per_shard * length * width for s in slot]
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(seq, pa.int64()), pa.array(slot, pa.int64()), pa.array(shard, pa.int32()), pa.array(offset, pa.int64()), pa.array(n, pa.int32()), pa.array(sha)],
                names=["seq", "slot", "shard", "byte_offset", "n_tokens", "sha256"],
            )

        shard_now = None
        for batch in batches:
            for slot, seq, shard, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if open_slot is not None and open_slot[1] != slot:
                    flush()
                    open_slot, body = None, b""
                if shard != shard_now:
                    if sink is not None:
                        close(shard_now)
                    shard_now = shard
                    store.create_dir(base, recursive=True)
                    name = f"{base}/shard-{shard:07d}.bin"
                    sink = store.open_output_stream(f"{name}.{attempt}.part")
                open_slot, body = (seq, slot), body + zlib.decompress(ids)
            if rows:
                yield listed()
        if open_slot is not None:
            flush()
        if sink is not None:
            close(shard_now)
        if rows:
            yield listed()

    return dealt.select("slot", "seq", "shard", "ids").mapInArrow(run, "seq long, slot long, shard int, byte_offset long, n_tokens int, sha256 string")


def read_slots(out_dir: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> Iterator[np.ndarray]:
    """Sequences of the slots first, first + 1, ..., read in order; stops after ``count`` or at the end."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out_dir)
    done = 0
    while done < count:
        shard, place = divmod(first + done, per_shard)
        name = f"{base}/shard-{shard:07d}.bin"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            return
        with store.open_input_file(name) as f:
            f.seek(place * length * width)
            while done < count and place < per_shard:
                data = f.read(length * width)
                if len(data) < length * width:
                    return
                yield np.frombuffer(data, np.uint16 if width == 2 else np.uint32)
                done, place = done + 1, place + 1
