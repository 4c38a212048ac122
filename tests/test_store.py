import pytest

from keelstone.operators import fold, maintain
from keelstone.schema import COMMANDS, MUTATIONS, NEVER
from keelstone.sources import runs, wal
from keelstone.store import KeyValueStore
from keelstone.streaming import streams


def test_library_calls(spark, tmp_path):
    now = [1000]
    s = KeyValueStore(spark, str(tmp_path / "db"), clock=lambda: now[0])
    assert s.get("a") is None and s.dbsize() == 0
    s.put("a", "10")
    s.put("b", "x", 5000)
    assert s.increment_by("a", 3) == 13 and s.get("a") == "13"
    with pytest.raises(ValueError):
        s.increment_by("b", 1)
    assert s.ttl("b") == 4000 and s.ttl("a") == -1 and s.ttl("zz") == -2
    assert s.persist("b") and not s.persist("b") and s.expire("b", 6000) and not s.expire("zz", 1)
    assert s.delete_if_present("a") and not s.delete_if_present("a")
    s.put("c", "z")
    before = [tuple(r) for r in s.scan("a", "z").collect()]
    s.compact()
    assert [tuple(r) for r in s.scan("a", "z").collect()] == before == [("b", "x"), ("c", "z")]
    now[0] = 6000
    assert s.get("b") is None and s.dbsize() == 1
    reopened = KeyValueStore(spark, str(tmp_path / "db"), clock=lambda: 7000)
    assert reopened.get("c") == "z"
    rows = spark.createDataFrame([("s", 1, 7000, ["SET", "d", "1"]), ("s", 2, 7000, ["INCR", "d"]), ("s", 3, 7000, ["DEL", "c"]), ("s", 4, 7000, ["DBSIZE"])], COMMANDS)
    assert [r["resp"] for r in reopened.execute(rows).orderBy("seq").collect()] == ["+OK\r\n", ":2\r\n", ":1\r\n", ":1\r\n"]
    assert reopened.get("d") == "2" and reopened.get("c") is None
    assert reopened.snapshot().endswith("snapshot-0000000007000.db") and reopened.last_snapshot_epoch_sec() == 7
    reopened.close()


def test_streams(spark, tmp_path):
    rows = [(i + 1, 0, "PUT", f"k{i % 3}", str(i), NEVER) for i in range(9)]
    spark.createDataFrame(rows, MUTATIONS).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(MUTATIONS).parquet(str(tmp_path / "in"))
    for _ in range(2):  # run again: nothing is written twice
        streams.ingest(source, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 9

    spark.createDataFrame([(1, 5, "news", "hi")], "msg_id bigint, seq bigint, channel string, payload string").write.parquet(str(tmp_path / "msgs"))
    msgs = spark.readStream.schema("msg_id bigint, seq bigint, channel string, payload string").parquet(str(tmp_path / "msgs"))
    subs = spark.createDataFrame([("c", "pattern", "n*", 0, NEVER)], "conn string, kind string, target string, seq_from bigint, seq_to bigint")
    got = []
    streams.deliver(msgs, lambda: subs, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck2")).awaitTermination(60)
    assert [(r["conn"], r["frame"]) for r in got] == [("c", "*4\r\n$8\r\npmessage\r\n$2\r\nn*\r\n$4\r\nnews\r\n$2\r\nhi\r\n")]


def test_streaming_fold_equals_batch_fold(spark, tmp_path):
    ops = [("a", 1, 0, 10, "SET", "5", 100), ("a", 2, 0, 20, "INCR", None, 2), ("b", 3, 0, 20, "INCR", None, 1), ("a", 4, 0, 100, "GET", None, None), ("a", 5, 0, 101, "INCR", None, 3), ("b", 6, 0, 1, "SET", "x", None), ("b", 7, 0, 2, "PERSIST", None, None), ("b", 8, 0, 3, "INCR", None, 1)]
    df = spark.createDataFrame(ops, fold.OPS)
    df.write.parquet(str(tmp_path / "ops"))
    want = sorted((r["seq"], r["num"], r["text"], r["err"]) for r in fold.fold(df).collect())
    q = streams.folded(spark.readStream.schema(fold.OPS).parquet(str(tmp_path / "ops"))).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r["seq"], r["num"], r["text"], r["err"]) for r in spark.table("folded").collect()) == want


def test_save_commands_write_snapshots(spark, tmp_path):
    s = KeyValueStore(spark, str(tmp_path / "db"), clock=lambda: 9000)
    s.put("old", "0")
    argv = [["SAVE", "x"], ["SET", "a", "1"], ["SAVE"], ["SET", "a", "2"], ["DEL", "old"], ["BGSAVE"], ["SET", "b", "3"], ["LASTSAVE"]]
    rows = spark.createDataFrame([("s", i, 1000 * i, a) for i, a in enumerate(argv, 1)], COMMANDS)
    assert s.execute(rows).filter("seq = 8").first()["num"] == s.last_snapshot_epoch_sec() == 6
    saved = {p.name: sorted((r["key"], r["value"]) for r in maintain.restore(spark, str(p)).collect()) for p in (tmp_path / "db").glob("snapshot-*")}
    assert saved == {"snapshot-0000000003000.db": [("a", "1"), ("old", "0")], "snapshot-0000000006000.db": [("a", "2")]}
    assert s.get("a") == "2" and s.get("b") == "3"


def test_raw_runs(spark, tmp_path):
    rows = [("PUT", "k", "v", NEVER), ("DEL", "gone", None, NEVER), ("PUT", "long", "ab" * 500, NEVER), ("PUT", "ü", "", 12), ("PUT", "z", "xy" * 90, 99)]
    data = runs.encode_run(rows)
    assert sorted(runs.decode_run(data), key=lambda r: r[1]) == sorted(rows, key=lambda r: r[1])
    assert len(data) < 700 and list(runs.decode_run(runs.encode_run([]))) == []
    for bad in (b"", data[:-1], data[:30] + data[-24:], b"\0" * 60, data[:-4] + b"abcd", data[:40] + b"\xff\xff\xff" + data[43:]):
        with pytest.raises(runs.BrokenRun):
            list(runs.decode_run(bad))


def test_take_over_of_a_raw_folder(spark, tmp_path):
    """Runs by number, the newest first to be believed, then the pending log and the active one."""
    old = tmp_path / "old"
    old.mkdir()
    (old / "sst-000001.db").write_bytes(runs.encode_run([("PUT", "a", "1", NEVER), ("PUT", "b", "1", NEVER), ("PUT", "c", "1" * 99, NEVER), ("PUT", "d", "1", NEVER)]))
    (old / "L1-000002.db").write_bytes(runs.encode_run([("PUT", "b", "2", NEVER), ("DEL", "c", None, NEVER)]))
    (old / "L2-000010.db").write_bytes(b"broken")
    (old / "snapshot-0000000000009.db").write_bytes(runs.encode_run([("PUT", "never", "x", NEVER)]))
    (old / "wal-pending.log").write_bytes(wal.frame("PUT", "d", "3") + wal.frame("PUT", "e", "3"))
    (old / "wal.log").write_bytes(wal.frame("DEL", "e") + wal.frame("PUT", "f", "4"))
    store = KeyValueStore(spark, str(tmp_path / "new"), clock=lambda: 1000)
    store.put("f", "own")
    store.put("own", "own")
    store.take_over(str(old))
    assert {r["key"]: r["value"] for r in store.view().collect()} == {"a": "1", "b": "2", "d": "3", "f": "4", "own": "own"}
    snap = runs.read_runs(spark, str(old / "snapshot-0000000000009.db"))
    assert [tuple(r) for r in snap.collect()] == [("snapshot-0000000000009.db", -1, -1, "PUT", "never", "x", NEVER)]
    with pytest.raises(Exception, match="BrokenRun"):
        runs.read_runs(spark, str(old)).count()


def test_expired_entries_leave_the_stream_state(spark, tmp_path):
    """The fold answers as in a batch; entries whose time has passed are gone from the state."""
    steps = [
        [("a", 1, 0, 1000, "SET", "x", 5000), ("b", 2, 0, 1000, "SET", "y", None), ("c", 3, 0, 1000, "SET", "z", 900_000)],
        [("b", 4, 0, 60_000, "GET", None, None), ("c", 5, 0, 60_000, "TTL", None, None)],
        [("b", 6, 0, 70_000, "DEL", None, None), ("a", 7, 0, 70_000, "GET", None, None)],
    ]
    want, got = [], []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, fold.OPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
        stream = streams.folded(spark.readStream.schema(fold.OPS).parquet(str(tmp_path / "ops")), late="1 second")
        query = stream.writeStream.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(90)
    every = spark.createDataFrame([r for rows in steps for r in rows], fold.OPS)
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in fold.fold(every).collect())
    held = spark.read.format("statestore").load(str(tmp_path / "ck")).select("key.*").collect()
    assert [r[0] for r in held] == ["c"]
