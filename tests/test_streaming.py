from pyspark.sql import functions as F

from noteloom.sources.log import SequencedLog
from noteloom.streaming.folds import entitlements
from noteloom.streaming.presence import presence
from noteloom.streaming.sync import apply_batches, keeps_history, safe_to_apply, sessions, tail, windowed_counts


def run(spark, tmp_path, batches, schema, build, name, mode="update"):
    src = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{src}")
    out = {}

    def take(df, _):
        for r in df.collect():
            out[r[0]] = r

    q = build(stream).writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", f"file://{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return out


def test_presence(spark, tmp_path):
    schema = "device string, ts long, gone boolean, note_id string, editing boolean"
    out = run(spark, tmp_path, [[("d", 5, False, "n", True), ("d", 9, False, "m", False), ("e", 4, False, "n", False), ("d", 7, True, None, False)], [("e", 6, True, None, False), ("e", 5, False, "x", True)]], schema, presence, "pres")
    assert (out["d"].ts, out["d"].note_id, out["d"].present) == (9, "m", True) and (out["e"].ts, out["e"].present) == (6, False)


def test_entitlements(spark, tmp_path):
    schema = "vault string, event_id long, type string, status string, created long, quota_bytes long"
    out = run(spark, tmp_path, [[("v", 1, "sub.updated", "active", 10, 100)], [("v", 2, "sub.updated", "canceled", 9, 1), ("w", 3, "sub.updated", "trialing", 5, 7)], [("w", 4, "sub.deleted", "active", 6, 7), ("w", 5, "sub.updated", "active", 6, 9)]], schema, entitlements, "ent")
    assert (out["v"].created, out["v"].active, out["v"].quota_bytes) == (10, True, 100) and (out["w"].created, out["w"].active) == (6, False)


def test_log_tail(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    log = SequencedLog(spark, root)
    rows = spark.createDataFrame([(i, 1, b"x") for i in range(4)], "pos int, ts long, blob binary")
    log.append(rows)
    seen = []
    apply = lambda df, b: seen.extend(r.seq for r in df.collect())
    for _ in range(2):
        q = apply_batches(tail(spark, root, 1), apply, f"file://{tmp_path}/cp", once=True)
        assert q.awaitTermination(90)
        log.append(rows)
    assert seen == [2, 3, 4, 5, 6, 7, 8]


def test_apply_guards(spark):
    t = lambda *r: spark.createDataFrame(list(r), "key string, hash string")
    changes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "key string, raw string")
    assert sorted(r.key for r in safe_to_apply(changes, t(("a", "1"), ("b", "2")), t(("a", "1"), ("b", "9"))).collect()) == ["a", "c"]
    assert keeps_history(200) and not keeps_history(201)


def test_windows(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string, value double"
    src = f"file://{tmp_path}/ev"
    e = spark.createDataFrame([(i * 60, 1, "view", 1.0) for i in range(12)], "s long, user_id long, event_type string, value double")
    e.select(F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value").write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    for build, name, n in ((windowed_counts, "w", 3), (lambda s: sessions(s, "90 seconds"), "s", 1)):
        q = build(stream).writeStream.outputMode("complete").format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        assert spark.table(f"out_{name}").count() == n


def test_of_equal_times_the_later_update_wins(spark, tmp_path):
    schema = "device string, ts long, gone boolean, note_id string, editing boolean, seq long"
    out = run(spark, tmp_path, [[("d", 5, True, None, False, 2), ("d", 5, False, "n", True, 1), ("e", 5, False, "n", True, 1)], [("e", 5, True, None, False, 2)]], schema, presence, "ties")
    assert not out["d"].present and not out["e"].present


def wait_for(condition, seconds=90):
    import time

    end = time.monotonic() + seconds
    while not condition():
        assert time.monotonic() < end, "it didn't come in time"
        time.sleep(0.2)


def test_silent_devices_are_reported_by_a_timer(spark, tmp_path):
    """Devices of the stream and of the state before it; one that goes on sending stays, one that has left isn't reported again."""
    schema = "device string, ts long, gone boolean, note_id string, editing boolean"
    src = f"file://{tmp_path}/in"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)
    put(("a", 5, False, "n", True), ("b", 5, True, None, False))
    before = spark.createDataFrame([("old", 3, "m", False), ("a", 9, "later", False)], "device string, ts long, note_id string, editing boolean")
    told = []
    made = presence(spark.readStream.schema(schema).parquet(src), ttl_ms=4000, initial=before)
    q = made.writeStream.outputMode("update").foreachBatch(lambda df, b: told.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        last = lambda: {r.device: r for r in told}
        wait_for(lambda: "old" in last() and "a" in last())
        assert (last()["old"].ts, last()["old"].present) == (3, False) and (last()["a"].ts, last()["a"].note_id, last()["a"].present) == (9, "later", False)
        assert [r.present for r in told if r.device == "b"] == [False]
        put(("a", 20, False, "back", True), ("old", 2, False, "late", True))
        wait_for(lambda: any(r.ts == 20 and r.present for r in told))
        wait_for(lambda: any(r.ts == 20 and not r.present for r in told))
        assert not [r for r in told if r.ts == 2]
    finally:
        q.stop()


def test_a_running_reader_survives_a_compaction(spark, tmp_path):
    from noteloom.sources.logsource import follow

    log = SequencedLog(spark, f"file://{tmp_path}/log")
    rows = lambda n: spark.createDataFrame([(i, 1, b"x%d" % i) for i in range(n)], "pos int, ts long, blob binary")
    log.append(rows(5))
    seen = []
    start = lambda: apply_batches(follow(spark, log.root, 2), lambda df, b: seen.extend((r.seq, r.idx, r.of) for r in df.collect()), f"file://{tmp_path}/cp")
    q = start()
    try:
        wait_for(lambda: len(seen) == 3)
        assert seen == [(3, None, None), (4, None, None), (5, None, None)]
        log.append(rows(4))
        wait_for(lambda: len(seen) == 7)
    finally:
        q.stop()
    log.append(rows(6))  # 10 to 15, which the stopped reader hasn't seen
    log.compact(12, spark.createDataFrame([(0, b"s0"), (1, b"s1")], "idx int, blob binary").repartition(2))
    q = start()
    try:
        wait_for(lambda: (15, None, None) in seen)
        assert seen[7:] == [(12, 0, 2), (12, 1, 2), (13, None, None), (14, None, None), (15, None, None)]
        log.compact(15, spark.createDataFrame([(0, b"s")], "idx int, blob binary"))
        log.append(rows(1))
        wait_for(lambda: (16, None, None) in seen)
        assert q.exception() is None
    finally:
        q.stop()


def test_files_that_go_while_a_batch_is_read(spark, tmp_path):
    from noteloom.sources.logsource import LogReader

    log = SequencedLog(spark, f"file://{tmp_path}/log")
    rows = lambda n: spark.createDataFrame([(i, 1, b"x") for i in range(n)], "pos int, ts long, blob binary").coalesce(1)
    log.append(rows(3))
    reader = LogReader(log.root, 0)
    planned = reader.partitions(reader.initialOffset(), reader.latestOffset())
    log.append(rows(2))
    log.compact(4, spark.createDataFrame([(0, b"s")], "idx int, blob binary"))
    got = [r for p in planned for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["seq"], r["idx"], r["blob"]) for r in got] == [(4, 0, b"s")]
