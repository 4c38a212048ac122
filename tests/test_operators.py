"""The operators on small tables whose answers are known."""

import random

import pytest
from pyspark.sql import functions as F

from keelstone.functions import resp, text
from keelstone.operators import acl, carry, fold, lookup, maintain, pubsub, resolve, sizes, stats
from keelstone.schema import MUTATIONS, NEVER
from keelstone.sources import wal


def log(spark, rows):
    """Mutations of (op, key, value, expiry) in order."""
    return spark.createDataFrame([(i + 1, 0, op, k, v, e) for i, (op, k, v, e) in enumerate(rows)], MUTATIONS)


def view(df, now=100):
    return {r["key"]: r["value"] for r in resolve.live(df, now).collect()}


def test_resolution(spark):
    rows = [("PUT", "k1", "a", NEVER), ("PUT", "k2", "b", NEVER), ("PUT", "k3", "c", NEVER), ("DEL", "k2", None, NEVER), ("PUT", "k1", "z", NEVER)]
    df = log(spark, rows)
    assert view(df) == {"k1": "z", "k3": "c"}
    assert [r["key"] for r in lookup.scan(resolve.live(df, 0), "k1", "k9").collect()] == ["k1", "k3"]
    assert view(log(spark, [])) == {}
    # the reference's in-band mark for deletes is an ordinary value here
    assert view(log(spark, [("PUT", "k", " __TOMBSTONE__ ", NEVER)])) == {"k": " __TOMBSTONE__ "}


def test_expiry_boundary(spark):
    df = log(spark, [("PUT", "a", "1", 100), ("PUT", "b", "1", 101), ("PUT", "c", "1", NEVER)])
    assert view(df) == {"b": "1", "c": "1"}
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("b",)], "key string")
    got = {r["key"]: (r["ttl_ms"], r["ttl_sec"]) for r in lookup.ttl(df, keys, 100).collect()}
    assert got == {"a": (-2, -2), "b": (1, 0), "c": (-1, -1), "d": (-2, -2)}


def test_scan_bounds(spark):
    df = resolve.live(log(spark, [("PUT", k, k, NEVER) for k in "abcd"]), 0)
    assert [r["key"] for r in lookup.scan(df, "b", "d").collect()] == ["b", "c"]
    assert lookup.scan(df, "b", "b").collect() == []
    with pytest.raises(ValueError):
        lookup.scan(df, "d", "b")


def test_compaction_changes_nothing(spark, tmp_path):
    rows = [("PUT", f"k{i % 7}", str(i), NEVER if i % 3 else 50) for i in range(60)] + [("DEL", "k3", None, NEVER)]
    df = log(spark, rows)
    want = view(df)
    assert view(maintain.compact(df, str(tmp_path / "full"), 100)) == want
    for cut in (1, 20, 45, 60):
        old, new = df.filter(F.col("seq") <= cut), df.filter(F.col("seq") > cut)
        assert view(resolve.merge_runs(old, maintain.compacted(new))) == want
        assert view(resolve.merge_runs(maintain.compact(old, str(tmp_path / f"c{cut}"), None), new)) == want


def test_snapshots(spark, tmp_path):
    df = log(spark, [("PUT", "a", "1", NEVER), ("PUT", "b", "1", 50), ("DEL", "a", None, NEVER), ("PUT", "c", "2", NEVER)])
    shots = maintain.Snapshots()
    path = shots.save(df, str(tmp_path), 5000)
    assert path.endswith("/snapshot-0000000005000.db") and shots.last_epoch_sec == 5
    assert view(maintain.restore(spark, path)) == {"c": "2"}
    assert view(maintain.restore(spark, shots.bgsave(df, str(tmp_path), 6000, upto_seq=2).result())) == {"a": "1"}
    shots.close()


@pytest.mark.parametrize(("start", "step", "want"), [(None, 5, 5), ("10", 3, 13), ("100", -5, 95), ("+7", 1, 8), ("007", 1, 8), ("alice", 1, fold.NOT_INTEGER), (" 5", 1, fold.NOT_INTEGER), ("5\n", 1, fold.NOT_INTEGER), (str(2**63 - 1), 1, fold.OVERFLOW), (str(-(2**63)), -1, fold.OVERFLOW)])
def test_counter_steps(start, step, want):
    before = None if start is None else (start, 999)
    state, changed, num, _, err = fold.step(before, "INCR", 10, None, step)
    assert (err or num) == want
    assert changed == (err is None) and (state == before if err else state == (str(num), 999 if before else NEVER))


def test_counter_restarts_at_expiry():
    assert fold.step(("5", 10), "INCR", 10, None, 2) == (("2", NEVER), True, 2, None, None)
    assert fold.step(("5", 11), "INCR", 10, None, 2) == (("7", 11), True, 7, None, None)


@pytest.mark.parametrize(("pattern", "value", "want"), [("*", "anything", True), ("news.*", "news.sports", True), ("user.?", "user.1", True), ("news.*", "weather.cold", False), ("user.?", "user.42", False), ("a*", "a\nb", False), ("x", "x\n", False), ("[ab]c", "bc", True), ("a{2}", "aa", True), ("a.c", "abc", False), ("", "", True)])
def test_globs(spark, pattern, value, want):
    df = spark.createDataFrame([(pattern, value)], "p string, t string")
    assert df.select(text.glob_match(F.col("p"), F.col("t"))).first()[0] is want


def test_routing(spark):
    subs = spark.createDataFrame([("a", "channel", "news", 0, NEVER), ("a", "pattern", "n*", 0, NEVER), ("b", "pattern", "n*", 0, 5), ("b", "pattern", "*s", 0, NEVER), ("c", "channel", "news", 5, NEVER)], "conn string, kind string, target string, seq_from bigint, seq_to bigint")
    msgs = spark.createDataFrame([(1, 3, "news", "hé"), (2, 6, "news", "x"), (3, 3, "other", "y")], "msg_id bigint, seq bigint, channel string, payload string")
    got = sorted(tuple(r) for r in pubsub.deliveries(msgs, subs).collect())
    assert got == [(1, "a", "channel", "news"), (1, "b", "pattern", "*s"), (2, "a", "channel", "news"), (2, "b", "pattern", "*s"), (2, "c", "channel", "news")]
    assert {r["msg_id"]: r["receivers"] for r in pubsub.publish_counts(msgs, subs).collect()} == {1: 2, 2: 3, 3: 0}
    frames = {(r["msg_id"], r["conn"]): r["frame"] for r in pubsub.frames(msgs, subs).collect()}
    assert frames[1, "a"] == "*3\r\n$7\r\nmessage\r\n$4\r\nnews\r\n$3\r\nhé\r\n"
    assert frames[1, "b"] == "*4\r\n$8\r\npmessage\r\n$2\r\n*s\r\n$4\r\nnews\r\n$3\r\nhé\r\n"


def test_many_globs_meet_many_channels(spark):
    """Globs by what they fix: the same pairs as each glob with each channel, and few of them looked at."""
    wild = ["*", "?", "??", "n*", "*s", "n?ws", "*a?b*", "*long run*", "a*long run*b", "[ab]c", "x[ab]*", "a{2}", "xa{2}?", "ba{0}c", "n.*", "*.1?", "?*?", "é?*", "?é", "*é*", "*\U0001f600?", "a]?", "[]a]?", "{n}".replace("{n}", "q?}")]
    names = ["", "n", "news", "ns", "nws", "a1b", "xa1by", "long run", "a long run b", "bc", "xab", "aa", "xaab", "bc1", "n.", "u.12", "u.1", "é1", "1é", "aé", "\U0001f600x", "y\U0001f600x", "a]x", "]x", "ax", "qx}", "a\nb", "n\n"]
    globs, channels = spark.createDataFrame([(g,) for g in wild], "target string"), spark.createDataFrame([(c,) for c in names], "channel string")
    got = sorted(tuple(r) for r in pubsub.met(channels, globs).collect())
    assert got == sorted(tuple(r) for r in globs.crossJoin(channels).filter(text.glob_match(F.col("target"), F.col("channel"))).collect())
    many = spark.range(300).select(F.format_string("n?ws%03d*", F.col("id")).alias("target"))
    plan = pubsub.met(spark.range(300).select(F.format_string("news%03dx", F.col("id")).alias("channel")), many)
    assert plan.count() == 300
    joins = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x and "RLIKE" in x]
    assert joins and all("shape" in x and "key" in x for x in joins)  # the expression is only asked within an equality join


def test_a_pattern_for_all_draws_messages_into_no_one_task(spark):
    msgs = spark.range(4000).select(F.col("id").alias("msg_id"), F.col("id").alias("seq"), F.concat(F.lit("c"), (F.col("id") % 500).cast("string")).alias("channel"), F.lit("x").alias("payload"))
    subs = spark.createDataFrame([("a", "pattern", "*", -1, NEVER), ("b", "pattern", "c1*", -1, NEVER)], "conn string, kind string, target string, seq_from bigint, seq_to bigint")
    assert pubsub.deliveries(msgs, subs).count() == 4000 + 8 * 111
    assert "REPARTITION_BY_NUM" in pubsub.deliveries(msgs, subs)._jdf.queryExecution().executedPlan().toString()
    held = pubsub.matches(msgs, subs)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [x for x in held if "Join " in x][0].count("channel") == 2  # the last join, the messages', is by channel


def test_frames_and_counts_stay_dealt(spark):
    """What is joined or counted by message keeps as many parts as shuffles have, and every message has one row."""
    msgs = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "b", "y"), (3, 3, "z", "w")], "msg_id bigint, seq bigint, channel string, payload string")
    subs = spark.createDataFrame([("c", "pattern", "?", -1, NEVER), ("d", "channel", "a", -1, NEVER)], "conn string, kind string, target string, seq_from bigint, seq_to bigint")
    by_message = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(msg_id" in x and ", conn" not in x and "REPARTITION_BY_NUM" in x]
    assert by_message(pubsub.frames(msgs, subs)) and pubsub.frames(msgs, subs).count() == 4
    counts = pubsub.publish_counts(msgs, subs)
    assert by_message(counts) and sorted(map(tuple, counts.collect())) == [(1, 2), (2, 1), (3, 1)]


def test_receivers_are_counted_by_hashing(spark):
    """A count needs no choice among a receiver's subscriptions, which would sort every part; a few messages need few parts."""
    msgs = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "b", "y"), (3, 3, "z", "w")], "msg_id bigint, seq bigint, channel string, payload string")
    subs = spark.createDataFrame([("c", "pattern", "?", -1, NEVER), ("c", "pattern", "[ab]", -1, NEVER), ("c", "channel", "a", -1, NEVER), ("d", "channel", "a", -1, NEVER)], "conn string, kind string, target string, seq_from bigint, seq_to bigint")
    for parts in (None, 3):
        counts = pubsub.publish_counts(msgs, subs, parts)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and (parts is None or "hashpartitioning(msg_id" in plan and ", 3), REPARTITION_BY_NUM" in plan)
        assert sorted(map(tuple, counts.collect())) == [(1, 2), (2, 1), (3, 1)]


def test_sums_at_reads_its_events_once(spark):
    events = spark.range(50).select((F.col("id") * 3).alias("seq"), F.lit(1).cast("bigint").alias("a"), F.col("id").alias("b"))
    out = carry.sums_at(spark.createDataFrame([(10,), (99,)], "seq bigint"), events, ["a", "b"], span=20)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(10, 4, 6), (99, 34, 561)]


def test_users(spark):
    assert acl.user_spec("a:b:get,Set") == ("a", "b", ["GET", "SET"]) and acl.user_spec("a:b:*")[2] == [] and acl.user_spec("a:b:")[2] == []
    for bad in ("a", ":b", "a:"):
        with pytest.raises(ValueError):
            acl.user_spec(bad)


def test_wal_prefix(spark, tmp_path):
    good = [wal.frame("PUT", "a", "1"), wal.frame("PUT", "é\0😀", "v", 77), wal.frame("DEL", "a")]
    whole = b"".join(good)
    assert [x[1:] for x in wal.replay(whole)] == [("PUT", "a", "1", NEVER), ("PUT", "é\0😀", "v", 77), ("DEL", "a", None, NEVER)]
    assert len(list(wal.replay(whole[:-3]))) == 2 and list(wal.replay(b"")) == [] and list(wal.replay(whole[:2])) == []
    broken = bytearray(whole)
    broken[len(good[0]) + 6] ^= 1
    assert len(list(wal.replay(bytes(broken)))) == 1
    assert list(wal.replay(wal.frame("PUT", "k", "v", None))) == [(0, "PUT", "k", "v", NEVER)]
    with pytest.raises(ValueError):
        wal.frame("PUT", "k" * 70_000, "v")
    (tmp_path / "wal.log").write_bytes(whole)
    (tmp_path / "empty.log").write_bytes(b"")
    assert view(wal.read_wal(spark, str(tmp_path)).drop("file")) == {} and wal.read_wal(spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize(("data", "want"), [(b"*0\r\n", [[]]), (b"*2\r\n$3\r\nGET\r\n$-1\r\n", [["GET", None]]), (b"*2\r\n$3\r\nSET\r\n$6\r\nab\r\ncd\r\n", [["SET", "ab\r\ncd"]]), (b"SET key value\r\n", [["SET", "key", "value"]]), (b" PING  x\n*1\r\n$4\r\nPING\r\n", [["PING", "x"], ["PING"]]), (b"", []), (b"\r\n\r\n", None)])
def test_decode(data, want):
    out, at = [], 0
    if want is None:  # a lone CRLF: the CR is the line's first byte, the LF ends it
        assert resp.parse_command(data, 0) == ([""], 2)
        return
    while True:
        argv, at = resp.parse_command(data, at)
        if argv is None:
            break
        out.append(argv)
    assert out == want


@pytest.mark.parametrize("data", [b"*1\r\n$4\r\nPI", b"*1\r\n", b"*x\r\n", b"*-2\r\n", b"*1\r\n+OK\r\n", b"*1\r\n$-2\r\n", b"*1\r\n$1\r\nabc", b"PING", b"*2000000\r\n", b"*1\n"])
def test_decode_errors(data):
    with pytest.raises(resp.ProtocolError):
        resp.parse_command(data, 0)


def test_decode_stream(spark):
    df = spark.createDataFrame([("s", b"*1\r\n$4\r\nPING\r\nGET k\r\n*1\r\n$9"), ("t", b"")], "session_id string, bytes binary")
    rows = sorted((r["pos"], r["argv"], r["error"] is None) for r in resp.decode(df).collect())
    assert rows == [(0, ["PING"], True), (1, ["GET", "k"], True), (2, None, False)]


def test_figures(spark):
    df = log(spark, [("PUT", "a😀", "xyz", NEVER), ("DEL", "a", None, NEVER)])
    assert stats.memtable_bytes(df).first()[0] == (2 * 3 + 2 * 3 + 8) + (2 + 8)
    assert stats.dbsize_approx(7, 149) == 9
    info = stats.info_text({"block_cache_hits": 1, "block_cache_misses": 2})
    assert "block_cache_hit_rate:0.3333\n" in info and info.startswith("# server\n") and "\n\n# limits\nmax_connections:unlimited\n" in info
    assert maintain.level_limit(1) == 10 << 20 and maintain.level_limit(3) == 1000 << 20
    row = spark.range(1).select(text.bloom_bits(F.lit(1000)).alias("m"), text.snapshot_name(F.lit(5000)).alias("s")).first()
    assert row["m"] == 9586 and row["s"] == "snapshot-0000000005000.db"


def test_null_requests(spark):
    df = resolve.live(log(spark, [("PUT", "a", "1", NEVER)]), 0)
    asked = spark.createDataFrame([(1, ["a", "b", "a", None])], "request_id bigint, keys array<string>")
    assert lookup.mget(df, asked).first()["values"] == ["1", None, "1", None]
    assert lookup.exists_count(df, asked).first()["n_exists"] == 2 and lookup.del_count(df, asked).first()["n_deleted"] == 1


def test_output_chunks(spark):
    rows = [("r" + str(i % 2), f"k{i:03d}", "v" * (i * 7 % 40)) for i in range(120)]
    got = {(r["run"], r["key"]): r["chunk"] for r in maintain.output_chunks(spark.createDataFrame(rows, "run string, key string, value string"), limit=300).collect()}
    for run in ("r0", "r1"):
        chunk = held = 0
        for _, key, value in sorted(r for r in rows if r[0] == run):
            if held >= 300:
                chunk, held = chunk + 1, 0
            held += 2 * len(key) + 2 * len(value) + 8
            assert got[run, key] == chunk


def test_checksums(spark):
    rows = [(0, b"abc", 891568578), (1, b"abd", 891568578), (2, b"", 0)]
    df = wal.checked(spark.createDataFrame([("f", *r) for r in rows], "file string, offset bigint, payload binary, stored_crc bigint"))
    assert {r["offset"]: r["bad"] for r in df.collect()} == {0: False, 1: True, 2: False}
    assert [r["offset"] for r in wal.valid_prefix(df).collect()] == [0]


def random_history(rng, n, keys):
    """Versions of some keys, one of which has most of them; points whose clocks are not in order."""
    at, rows, seq, clock = {}, [], 0, 1000
    for _ in range(n):
        seq += rng.randint(1, 3)
        clock += rng.randint(0, 30)
        key = "hot" if rng.random() < 0.6 else rng.choice(keys)
        until = rng.choice([NEVER, clock + rng.randint(1, 400)])
        if key in at:
            rows[at[key]][2] = seq
        at[key] = len(rows)
        rows.append([key, seq, NEVER, rng.choice(["PUT", "PUT", "DEL"]), f"v{seq}", until])
    points = [(rng.randint(0, seq + 5), 1000 + rng.randint(0, 15 * n)) for _ in range(40)]
    return rows, list({s: (s, t) for s, t in points}.values())


@pytest.mark.parametrize("span", [7, 100_000])
def test_reads_at_points_against_plain_loops(spark, span):
    rng = random.Random(span)
    for n in (0, 1, 60):
        rows, points = random_history(rng, n, ["a", "b", "hot", "user:1", "zé"])
        held = spark.createDataFrame(rows, "key string, seq_from bigint, seq_to bigint, op string, value string, expires_at_ms bigint")
        asked = spark.createDataFrame(points, "seq bigint, ts_ms bigint")
        alive = lambda s, t: [r for r in rows if r[3] != "DEL" and r[1] < s <= r[2] and r[5] > t]
        got = {r["seq"]: r["dbsize"] for r in sizes.dbsize_at(held, asked, span).collect()}
        assert got == {s: len(alive(s, t)) for s, t in points}
        scans = [(s, t, *sorted(rng.choice(["", "a", "b", "h", "hot", "hot2", "user:1", "z", "~"]) for _ in range(2))) for s, t in points]
        got = sorted((r["seq"], r["key"], r["value"]) for r in sizes.scan_at(held, spark.createDataFrame(scans, "seq bigint, ts_ms bigint, lo string, hi string")).collect())
        assert got == sorted((s, r[0], r[4]) for s, t, lo, hi in scans for r in alive(s, t) if lo <= r[0] < hi)
        reads = [(i, rng.choice(["a", "hot", "hot", "none"]), s, t) for i, (s, t) in enumerate(points)]
        got = {r["request_id"]: r["value"] for r in resolve.as_of(held, spark.createDataFrame(reads, "request_id bigint, key string, at_seq bigint, now_ms bigint")).collect()}
        want = {i: next((r[4] for r in rows if r[0] == k and r[1] <= s < r[2] and r[3] != "DEL" and r[5] > t), None) for i, k, s, t in reads}
        assert got == want
    assert sizes.dbsize_at(held, asked.limit(0)).count() == 0 and sizes.scan_at(held, spark.createDataFrame([], "seq bigint, ts_ms bigint, lo string, hi string")).count() == 0


@pytest.mark.parametrize("how", ["sum", "max", "last"])
def test_carried_ranges(spark, how):
    rng = random.Random(9)
    rows = [(r, rng.choice([None, rng.randint(-9, 9)])) for r in sorted(rng.sample(range(-50, 200), 60))]
    got = {r["_range"]: r["_start"] for r in carry.carried(spark.createDataFrame(rows, "_range bigint, _end bigint"), how, wide=7).collect()}
    for i, (r, _) in enumerate(rows):
        seen = [x for _, x in rows[:i] if x is not None]
        assert got[r] == {"sum": sum(seen), "max": max(seen, default=None), "last": seen[-1] if seen else None}[how]


def test_sizes_are_summed_once(spark, monkeypatch):
    """The changes of the size are worked out once, few ranges need one level, and no clock behind needs no join; each way gives the same sizes."""
    rng = random.Random(4)
    rows, points = random_history(rng, 60, ["a", "b", "hot"])
    held = spark.createDataFrame(rows, "key string, seq_from bigint, seq_to bigint, op string, value string, expires_at_ms bigint")
    ordered = [(s, 1000 + 10 * i) for i, s in enumerate(sorted(s for s, _ in points))]
    for asked, joins in ((points, 3), (ordered, 1)):
        want = {s: sum(r[3] != "DEL" and r[1] < s <= r[2] and r[5] > t for r in rows) for s, t in asked}
        for few in (0, sizes.FEW):
            monkeypatch.setattr(sizes, "FEW", few)
            got = sizes.dbsize_at(held, spark.createDataFrame(asked, "seq bigint, ts_ms bigint"), 7)
            assert {r["seq"]: r["dbsize"] for r in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == joins
    ends = spark.createDataFrame([(5, 2), (1, 4), (9, None), (12, 1)], "_range bigint, _end bigint")
    for how, want in (("sum", [0, 4, 6, 6]), ("max", [None, 4, 4, 4]), ("last", [None, 4, 2, 2])):
        found = carry.carried(ends, how, few=True)
        assert [r["_start"] for r in found.orderBy("_range").collect()] == want and "Join" not in found._jdf.queryExecution().toString()


def test_reads_at_points_use_no_product(spark):
    """As-of reads join by sorting; sizes and scans by equality only; nothing goes through the driver's hands."""
    held = spark.range(10).selectExpr("CAST(id % 2 AS STRING) AS key", "id AS seq_from", "id + 2 AS seq_to", "'PUT' AS op", "'v' AS value", "id + 100 AS expires_at_ms")
    asked = spark.range(10).selectExpr("id AS request_id", "CAST(id AS STRING) AS key", "id AS at_seq", "id AS now_ms", "id AS seq", "id * 90 AS ts_ms", "CAST(id AS STRING) AS lo", "CAST(id + 5 AS STRING) AS hi")
    for df in (resolve.as_of(held, asked), sizes.dbsize_at(held, asked), sizes.scan_at(held, asked)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "Join" not in resolve.as_of(held, asked)._jdf.queryExecution().toString()
