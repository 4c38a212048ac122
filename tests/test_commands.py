import random

import pytest

from keelstone.operators import acl, commands
from keelstone.schema import COMMANDS

from .model import Model, enc


def ask(spark, rows, **more):
    """Replies of (session, argv) rows, one second apart."""
    df = spark.createDataFrame([(s, i + 1, 1_000_000 + 1000 * i, list(a)) for i, (s, a) in enumerate(rows)], COMMANDS)
    out = commands.interpret(df, **more)
    return {r["seq"]: r["resp"] for r in out.replies.collect()}, out.log


def test_replies(spark):
    rows = [
        (["PING"], "+PONG\r\n"), (["PING", "hello"], "$5\r\nhello\r\n"), (["GET", "nope"], "$-1\r\n"),
        (["MSET", "a", "1", "b", "2"], "+OK\r\n"), (["DEL", "a", "b", "c"], ":2\r\n"), (["set", "a", "1"], "+OK\r\n"),
        (["SET", "c", "3"], "+OK\r\n"), (["EXISTS", "a", "a", "missing"], ":2\r\n"), (["MGET", "a", "b", "c", "a"], "*4\r\n$1\r\n1\r\n$-1\r\n$1\r\n3\r\n$1\r\n1\r\n"),
        (["MSET", "a", "1", "b"], "-ERR wrong number of arguments for 'MSET'\r\n"), (["DEL", "a", "a"], ":1\r\n"),
        (["SET", "k1", "v1"], "+OK\r\n"), (["SET", "k2", "v2"], "+OK\r\n"), (["SET", "k3", "v3"], "+OK\r\n"),
        (["SCAN", "k1", "k3"], "*4\r\n$2\r\nk1\r\n$2\r\nv1\r\n$2\r\nk2\r\n$2\r\nv2\r\n"), (["SCAN", "k1", "k1"], "*0\r\n"),
        (["SCAN", "0"], "-" + commands.SCAN_HELP + "\r\n"), (["FROBNICATE"], "-ERR unknown command 'FROBNICATE'\r\n"),
        (["INCRBY", "x", "10"], ":10\r\n"), (["INCRBY", "x", "15"], ":25\r\n"), (["DECRBY", "x", "5"], ":20\r\n"), (["INCRBY", "x", "no"], "-ERR value is not an integer or out of range\r\n"),
        (["SETEX", "k", "0", "v"], "-ERR invalid expire time in 'setex' command\r\n"), (["PSETEX", "k", "-1", "v"], "-ERR invalid expire time in 'psetex' command\r\n"),
        (["SET", "k", "v", "EX", "0"], "+OK\r\n"), (["GET", "k"], "$-1\r\n"), (["SET", "k", "v", "NX"], "-ERR syntax error\r\n"),
        (["SETEX", "t", "60", "v"], "+OK\r\n"), (["TTL", "t"], ":59\r\n"), (["PTTL", "t"], ":58000\r\n"), (["PERSIST", "t"], ":1\r\n"), (["TTL", "t"], ":-1\r\n"), (["TTL", "zz"], ":-2\r\n"),
        (["LASTSAVE"], ":0\r\n"), (["BGSAVE", "NOPE"], "-ERR syntax error\r\n"), (["BGSAVE"], "+Background saving started\r\n"), (["LASTSAVE"], ":1035\r\n"), (["COMMAND", "x"], "*0\r\n"),
        (["DBSIZE"], ":6\r\n"), ([], "-ERR empty command\r\n"), (["GET"], "-ERR wrong number of arguments for 'GET'\r\n"), (["GET", None], "-ERR internal: null argument\r\n"),
        (["AUTH", "pw"], "-ERR Client sent AUTH, but no password is set. Did you mean AUTH <username> <password>?\r\n"), (["QUIT"], "+OK\r\n"), (["PING"], None),
    ]
    got, _ = ask(spark, [("s", a) for a, _ in rows])
    for i, (argv, want) in enumerate(rows):
        assert got.get(i + 1) == want, argv


def test_gates(spark):
    users = acl.users(spark, ["ann:pw:GET,exists", "bob:secret:*"], password="top")
    rows = [
        ("a", ["GET", "k"], "-NOAUTH Authentication required.\r\n"), ("a", ["PING"], "+PONG\r\n"), ("a", ["AUTH", "ann", "no"], "-WRONGPASS invalid username-password pair or user is disabled.\r\n"),
        ("a", ["AUTH", "ann", "pw"], "+OK\r\n"), ("a", ["get", "k"], "$-1\r\n"), ("a", ["SET", "k", "v"], "-NOPERM this user has no permissions to run the 'SET' command\r\n"),
        ("b", ["AUTH", "top"], "+OK\r\n"), ("b", ["SET", "k", "v"], "+OK\r\n"), ("a", ["GET", "k"], "$1\r\nv\r\n"),
        ("c", ["AUTH", "bob", "secret"], "+OK\r\n"), ("c", ["SUBSCRIBE", "news", "x"], "*3\r\n$9\r\nsubscribe\r\n$4\r\nnews\r\n:1\r\n*3\r\n$9\r\nsubscribe\r\n$1\r\nx\r\n:2\r\n"),
        ("c", ["PSUBSCRIBE", "n*"], "*3\r\n$10\r\npsubscribe\r\n$2\r\nn*\r\n:3\r\n"), ("b", ["PUBLISH", "news", "m"], ":1\r\n"), ("b", ["PUBLISH", "nx", "m"], ":1\r\n"), ("b", ["PUBLISH", "q", "m"], ":0\r\n"),
        ("c", ["GET", "k"], "-ERR Can't execute 'GET' in subscribe context, only (P)SUBSCRIBE / (P)UNSUBSCRIBE / PING / QUIT are allowed\r\n"),
        ("c", ["UNSUBSCRIBE"], "*3\r\n$11\r\nunsubscribe\r\n$4\r\nnews\r\n:2\r\n*3\r\n$11\r\nunsubscribe\r\n$1\r\nx\r\n:1\r\n"),
        ("c", ["UNSUBSCRIBE"], "*3\r\n$11\r\nunsubscribe\r\n$-1\r\n:0\r\n"), ("b", ["PUBLISH", "news", "m"], ":1\r\n"), ("c", ["PUNSUBSCRIBE"], "*3\r\n$12\r\npunsubscribe\r\n$2\r\nn*\r\n:0\r\n"), ("b", ["PUBLISH", "news", "m"], ":0\r\n"),
    ]
    got, _ = ask(spark, [(s, a) for s, a, _ in rows], users=users)
    for i, (_, argv, want) in enumerate(rows):
        assert got.get(i + 1) == want, argv


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_equal_the_model(spark, seed):
    rng = random.Random(seed)
    key = lambda: f"k{rng.randrange(12)}"
    make = [
        lambda: ["SET", key(), rng.choice(["1", "x", "9223372036854775807", "-5", "+7", "007"])], lambda: ["SET", key(), "5", rng.choice(["EX", "px"]), str(rng.randrange(-2, 6))],
        lambda: ["INCRBY", key(), str(rng.randrange(-3, 9))], lambda: ["DECR", key()], lambda: ["DEL", key(), key()], lambda: ["EXPIRE", key(), str(rng.randrange(-1, 5))],
        lambda: ["PERSIST", key()], lambda: ["TTL", key()], lambda: ["PTTL", key()], lambda: ["GET", key()], lambda: ["MGET", key(), key(), "none"], lambda: ["EXISTS", key(), key()],
        lambda: ["MSET", (k := key()), "1", k, "2", key(), "3"], lambda: ["SCAN", "k1", "k5"], lambda: ["DBSIZE"],
    ]
    rows = [("s", rng.choice(make)()) for _ in range(500)]
    got, log = ask(spark, rows)
    model = Model()
    for i, (_, argv) in enumerate(rows):
        assert got[i + 1] == enc(model.run(argv, 1_000_000 + 1000 * i)), (i, argv)
    now = 1_000_000 + 1000 * len(rows)
    left = {r["key"]: (r["value"], r["expires_at_ms"]) for r in commands.state_after(log).filter("op <> 'DEL'").collect() if r["expires_at_ms"] > now}
    assert left == {k: v for k, v in model.d.items() if v[1] > now}


def test_last_before(spark):
    points = spark.createDataFrame([(i,) for i in (1, 5, 12, 25, 40, 99)], "seq bigint")
    events = spark.createDataFrame([(2, 20), (11, 110), (24, 240), (41, 410)], "seq bigint, at bigint")
    got = {r["seq"]: r["at"] for r in commands.last_before(points, events, span=10).collect()}
    assert got == {1: None, 5: 20, 12: 110, 25: 240, 40: 240, 99: 410}


def test_sessions_go_on(spark):
    users = acl.users(spark, ["ann:pw"])
    table = lambda rows: spark.createDataFrame([(s, i, 1000, a) for s, i, a in rows], COMMANDS)
    first = commands.interpret(table([("a", 1, ["AUTH", "ann", "pw"]), ("b", 2, ["AUTH", "ann", "pw"]), ("b", 3, ["SUBSCRIBE", "news"]), ("b", 4, ["PSUBSCRIBE", "x*"]), ("c", 5, ["QUIT"])]), users)
    again = commands.interpret(table([("a", 11, ["PUBLISH", "news", "m"]), ("b", 12, ["GET", "k"]), ("b", 13, ["UNSUBSCRIBE"]), ("c", 14, ["PING"]), ("d", 15, ["GET", "k"]), ("a", 16, ["PUBLISH", "news", "m"]), ("a", 17, ["PUBLISH", "xy", "m"])]), users, sessions=first.sessions)
    got = {r["seq"]: r["resp"] for r in again.replies.collect()}
    assert got[11] == ":1\r\n" and got[16] == ":0\r\n" and got[17] == ":1\r\n" and 14 not in got and got[15].startswith("-NOAUTH")
    assert got[12].startswith("-ERR Can't execute 'GET'") and got[13] == "*3\r\n$11\r\nunsubscribe\r\n$4\r\nnews\r\n:1\r\n"
    assert {r["session_id"]: r["state"] for r in again.sessions.collect()} == {"a": ["ann", "0", "0"], "b": ["ann", "0", "0", "x*"], "c": ["", "1", "0"], "d": ["", "0", "0"]}


def test_named_commands_get_the_replies_of_the_whole(spark):
    """Walking only what some commands depend on changes none of their replies; steps that they do not need are not run."""
    rng = random.Random(3)
    key = lambda: f"k{rng.randrange(6)}"
    make = [
        lambda: ["set", key(), "5", "PX", str(rng.randrange(1, 9000))], lambda: ["GET", key()], lambda: ["MSET", key(), "1", key(), "2"], lambda: ["MGET", key(), key()], lambda: ["DEL", key(), key()],
        lambda: ["INCR", key()], lambda: ["SCAN", "k1", "k4"], lambda: ["DBSIZE"], lambda: ["ping", "x"], lambda: ["GET"], lambda: ["NOSUCH"], lambda: [], lambda: ["GET", None],
        lambda: ["SUBSCRIBE", "news"], lambda: ["PSUBSCRIBE", "n*"], lambda: ["UNSUBSCRIBE"], lambda: ["PUNSUBSCRIBE"], lambda: ["PUBLISH", "news", "m"], lambda: ["SAVE"], lambda: ["LASTSAVE"], lambda: ["INFO"],
    ]
    rows = [(rng.choice("abcdefgh"), rng.choice(make)()) for _ in range(400)] + [("b", ["QUIT"]), ("b", ["PING"]), ("c", ["UNSUBSCRIBE"]), ("c", ["PUNSUBSCRIBE"]), ("c", ["SHUTDOWN"]), ("a", ["PING"])]
    df = spark.createDataFrame([(s, i + 1, 1_000_000 + 1000 * i, a) for i, (s, a) in enumerate(rows)], COMMANDS)
    name = {i + 1: a[0].upper() for i, (_, a) in enumerate(rows) if a}
    whole = {r["seq"]: r["resp"] for r in commands.interpret(df).replies.collect()}
    session = {"PING", "PUBLISH", "LASTSAVE"}
    for group in (commands.DATA | {"SCAN", "DBSIZE"}, {"INFO"}, session):
        walked = commands.Interpreter(df, only=group)
        for names in [group] if group != session else [{c} for c in sorted(session)]:
            got = {r["seq"]: r["resp"] for r in walked.replies(names).collect()}
            assert got and got == {n: x for n, x in whole.items() if name.get(n) in names}
        assert ("folded" in vars(walked)) == (group != session)
    with pytest.raises(ValueError):
        walked.replies(["GET"])


def test_dealt_sessions_are_not_shuffled_again(spark):
    from keelstone.plans import wire

    from .test_plans import plan_of

    plan = plan_of(commands.plan(wire.rows(spark, "/root/testdata/sf0.001", wire.SCRIPT), dealt=True))
    assert plan.count("Exchange") == 1 and "session_id" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_a_command_alone_gets_the_replies_of_the_whole(spark):
    """What a command's replies do not depend on is neither walked nor folded: writes are answered without their keys."""
    rng = random.Random(5)
    key = lambda: f"k{rng.randrange(5)}"
    make = [
        lambda: ["set", key(), "5"], lambda: ["SET", key(), "5", "XX"], lambda: ["PSETEX", key(), str(rng.randrange(0, 9000)), "7"], lambda: ["MSET", (k := key()), "1", k, "2", key(), "3"], lambda: ["MSET", key()],
        lambda: ["MGET", key(), key()], lambda: ["EXISTS", key(), key()], lambda: ["DEL", key(), key()], lambda: ["DEL", key()], lambda: ["INCR", key()], lambda: ["PEXPIRE", key(), "3000"], lambda: ["PERSIST", key()], lambda: ["PTTL", key()],
        lambda: ["DBSIZE"], lambda: ["SUBSCRIBE", "news"], lambda: ["UNSUBSCRIBE"], lambda: ["PUBLISH", "news", "m"], lambda: ["COMMAND"], lambda: ["SAVE"], lambda: ["LASTSAVE"], lambda: ["NOSUCH"], lambda: [],
    ]
    rows = [(rng.choice("abcdefgh"), rng.choice(make)()) for _ in range(400)] + [("b", ["QUIT"]), ("b", ["COMMAND"]), ("c", ["UNSUBSCRIBE"]), ("c", ["SHUTDOWN"]), ("a", ["COMMAND"])]
    df = spark.createDataFrame([(s, i + 1, 1_000_000 + 1000 * i, a) for i, (s, a) in enumerate(rows)], COMMANDS)
    name = {i + 1: a[0].upper() for i, (_, a) in enumerate(rows) if a}
    whole = {r["seq"]: r["resp"] for r in commands.interpret(df).replies.collect()}
    for c in ("MSET", "PSETEX", "MGET", "DEL", "PTTL", "DBSIZE", "PUBLISH", "COMMAND", "LASTSAVE", "UNSUBSCRIBE"):
        walked = commands.Interpreter(df, only=[c])
        got = {r["seq"]: r["resp"] for r in walked.replies().collect()}
        assert len(got) > 3 and got == {n: x for n, x in whole.items() if name.get(n) == c}, c
        kept = {r["cmd"] for r in walked.planned.select("cmd").distinct().collect()}
        assert ("folded" in vars(walked)) == (c in commands.KEYED) and not kept & (commands.READS | {None, "_STATE"}) - {c}, c
    with pytest.raises(ValueError):
        walked.log  # noqa: B018 (walked without the writes)


def test_steps_that_a_command_depends_on():
    from keelstone.plans import wire

    names = lambda c: [wire.SCRIPT[i][2][0].upper() for i in wire.needed(wire.SCRIPT, c)]
    assert names("INFO") == ["PING", "PING", "PING", "SET", "INFO"] and names("MSET") == ["MSET", "MSET"] and names("PSETEX") == ["PSETEX"]
    assert set(names("PERSIST")) == {"SET", "PERSIST"} and "GET" not in names("DBSIZE") and names("GET")[-1] == "GET"
    assert all(wire.needed(wire.SCRIPT, c)[-1] == max(i for i, x in enumerate(wire.SCRIPT) if x[2][0].upper() == c) for c in {x[2][0].upper() for x in wire.SCRIPT})


def test_one_column_of_lists_goes_to_the_walk(spark):
    """A second one, mostly null, took most of the walk's time."""
    df = spark.createDataFrame([("s", 1, 1000, ["PING"])], COMMANDS)
    for states in (None, spark.createDataFrame([("s", ["", "0", "0"])], "session_id string, state array<string>")):
        child = commands.plan(df, None, states)._jdf.queryExecution().analyzed().children().head().schema()
        assert [f.name() for f in child.fields() if "array" in f.dataType().simpleString()] == ["argv"]


def test_listed_equals_to_pylist():
    import pyarrow as pa

    from keelstone.operators.fold import HIGH, LOW, listed

    for values, kind in (([LOW, None, HIGH, 0], pa.int64()), ([LOW, HIGH], pa.int64()), ([1, None], pa.int32()), (["é", None, "", "\0"], pa.string()), ([True, False], pa.bool_()), ([True, None], pa.bool_()), ([None, None], pa.string()), ([], pa.int64()), ([["a"], None], pa.list_(pa.string()))):
        column = pa.array(values, kind)
        assert listed(column) == column.to_pylist() and list(map(type, listed(column))) == list(map(type, column.to_pylist()))


def test_replies_of_one_step_come_in_one_pass(spark):
    """Where it is known that no SHUTDOWN occurs, the walk goes on to the fold or to the replies: nothing is stored on the way, each row is walked once."""
    from .test_plans import plan_of

    rng = random.Random(7)
    key = lambda: f"k{rng.randrange(5)}"
    make = [
        lambda: ["set", key(), "5"], lambda: ["SET", key()], lambda: ["MSET", (k := key()), "1", k, "2", key(), "x"], lambda: ["GET", key()], lambda: ["GET"], lambda: ["MGET", key(), key()], lambda: ["MGET", key()], lambda: ["MGET"],
        lambda: ["EXISTS", key(), key()], lambda: ["EXISTS", key()], lambda: ["DEL", key(), key()], lambda: ["DEL", key()], lambda: ["INCR", key()], lambda: ["INCRBY", key(), rng.choice(["1", "z"])], lambda: ["PEXPIRE", key(), "3000"], lambda: ["TTL", key()],
        lambda: ["SUBSCRIBE", "news"], lambda: ["UNSUBSCRIBE"], lambda: ["PING", "x"], lambda: ["NOSUCH"], lambda: [],
    ]
    rows = [(rng.choice("abcdefgh"), rng.choice(make)()) for _ in range(500)] + [("b", ["QUIT"]), ("b", ["PING"]), ("b", ["GET", "k1"])]
    df = spark.createDataFrame([(s, i + 1, 1_000_000 + 1000 * i, a) for i, (s, a) in enumerate(rows)], COMMANDS)
    name = {i + 1: a[0].upper() for i, (_, a) in enumerate(rows) if a}
    whole = {r["seq"]: r["resp"] for r in commands.interpret(df).replies.collect()}
    for only in ({"GET"}, {"INCRBY"}, {"PEXPIRE"}, {"DEL"}, {"MGET", "EXISTS", "TTL"}, {"PING"}, {"MSET"}, {"UNSUBSCRIBE", "QUIT", "SET"}):
        found = commands.Interpreter(df, only=only, names=set(name.values())).replies()
        got = found.collect()
        assert len(got) == len({r["seq"] for r in got}) and {r["seq"]: r["resp"] for r in got} == {n: x for n, x in whole.items() if name.get(n) in only}, only
        plan = plan_of(found).split("Initial Plan")[-1]
        assert plan.count("MapInArrow") == 1 + bool(only & commands.KEYED) and "parquet" not in plan.lower(), only
    assert not commands.Interpreter(df, only={"GET"}, names={"GET", "SHUTDOWN"}).once and not commands.Interpreter(df, only={"GET"}).once


def test_a_small_script_is_walked_by_few_tasks(spark, tmp_path):
    """Two for each core, however many parts shuffles have; a session's commands lie together in their order."""
    from keelstone.plans import wire
    from keelstone.session import table

    suppliers = table(spark, "/root/testdata/sf0.001", "supplier")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        parts = wire.parts_for(suppliers)
        assert parts == 2 * spark.sparkContext.defaultParallelism
        laid = wire.rows(spark, "/root/testdata/sf0.001", wire.SCRIPT, parts=parts)
        assert laid.rdd.getNumPartitions() == parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for part in laid.select("session_id", "seq").rdd.map(tuple).glom().collect():
        sessions = [s for i, (s, _) in enumerate(part) if not i or part[i - 1][0] != s]
        assert len(sessions) == len(set(sessions)) and all(a[0] != b[0] or a[1] < b[1] for a, b in zip(part, part[1:], strict=False))
