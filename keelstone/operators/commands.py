"""The command interpreter: rows of ``session_id, seq, ts_ms, argv`` to rows of replies.

1. Sessions. Each session's rows are walked once in order (gates, arity, syntax, authentication and
   subscriptions need only that); a row gets its answer or the per-key operations it stands for.
2. Keys. All operations are folded for each key in order of ``seq`` (see ``fold``).
3. Reads of many keys (SCAN, DBSIZE) meet the versions that the fold wrote, as of their ``seq``.
4. Answers are put together for each command and encoded.

``seq`` is unique and orders all sessions; ``ts_ms`` is the clock of each command.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import resp
from ..functions.text import entry_bytes
from ..schema import DEL, NEVER
from ..session import stored, tasks_for
from . import fold, pubsub, sizes, stats
from .carry import carried
from .fold import HIGH, LOW, NOT_INTEGER, listed, long_of
from .resolve import latest_per_key

#: Commands that run before authentication, and those allowed while subscribed.
OPEN = {"AUTH", "PING", "QUIT", "COMMAND"}
SUBSCRIBED = {"SUBSCRIBE", "UNSUBSCRIBE", "PSUBSCRIBE", "PUNSUBSCRIBE", "PING", "QUIT"}
#: Bytes of stored commands whose messages one task counts the receivers of, about (some ten thousand).
SHARE = 262_144
SYNTAX = "ERR syntax error"
SCAN_HELP = "ERR This server uses SCAN <from> <to> (range scan), not cursor-based SCAN"

#: Flat, as nested columns are slow to write. A command has one row: its answer (``type``), or none yet (``key`` and ``value``
#: hold its arguments); a data command has instead a row for each of its ``size`` operations (the first of them has its answer
#: too, where that is known without the key). Changes of subscriptions follow
#: their command's row, by ``op`` (ADD or REMOVE; ``key`` the target, ``value`` its kind), with type 'none'.
_PLAN = "session_id string, seq bigint, ts_ms bigint, cmd string, type string, text string, num bigint, items array<string>, size int, pos int, key string, op string, value string, n bigint"


class _Answer(Exception):
    def __init__(self, kind: str, text: str | None = None, num: int | None = None, items: list | None = None):
        super().__init__()
        self.row = (kind, text, num, items)


def _error(text: str) -> _Answer:
    return _Answer("-", text)


def _arity(ok: bool, cmd: str) -> None:
    if not ok:
        raise _error(f"ERR wrong number of arguments for '{cmd}'")


def _integer(text: str) -> int:
    n = long_of(text)
    if n is None:
        raise _error(NOT_INTEGER)
    return n


def _expiry(now: int, n: int, seconds: bool) -> int:
    """The absolute expiry; what would leave 64 bits is an error, never a wrapped time."""
    at = now + n * (1000 if seconds else 1)
    if not LOW <= at <= HIGH:
        raise _error(NOT_INTEGER)
    return at


def operations(cmd: str, argv: list[str], now: int) -> list[tuple[str, str, str | None, int | None]]:
    """The per-key operations ``(key, op, value, n)`` of a data command; raises its answer if it has none."""
    a, n = argv[1:], len(argv)
    if cmd == "SET":
        _arity(n >= 3, cmd)
        until, i = None, 2
        while i < len(a):
            if a[i].upper() not in ("EX", "PX") or i + 1 >= len(a):
                raise _error(SYNTAX)
            until = _expiry(now, _integer(a[i + 1]), a[i].upper() == "EX")
            i += 2
        return [(a[0], "SET", a[1], until)]
    if cmd in ("SETEX", "PSETEX"):
        _arity(n == 4, cmd)
        ttl = _integer(a[1])
        if ttl <= 0:
            raise _error(f"ERR invalid expire time in '{cmd.lower()}' command")
        return [(a[0], "SET", a[2], _expiry(now, ttl, cmd == "SETEX"))]
    if cmd == "GET":
        _arity(n == 2, cmd)
        return [(a[0], "GET", None, None)]
    if cmd in ("DEL", "EXISTS", "MGET"):
        _arity(n >= 2, cmd)
        return [(k, "DEL" if cmd == "DEL" else "GET", None, None) for k in a]
    if cmd == "MSET":
        _arity(n >= 3 and n % 2 == 1, cmd)
        return [(k, "SET", v, None) for k, v in zip(a[::2], a[1::2], strict=True)]
    if cmd in ("INCR", "DECR"):
        _arity(n == 2, cmd)
        return [(a[0], "INCR", None, 1 if cmd == "INCR" else -1)]
    if cmd in ("INCRBY", "DECRBY"):
        _arity(n == 3, cmd)
        step = _integer(a[1])
        if cmd == "DECRBY":
            if step == LOW:
                raise _error(fold.OVERFLOW)
            step = -step
        return [(a[0], "INCR", None, step)]
    if cmd in ("EXPIRE", "PEXPIRE"):
        _arity(n == 3, cmd)
        return [(a[0], "EXPIRE", None, _expiry(now, _integer(a[1]), cmd == "EXPIRE"))]
    if cmd in ("TTL", "PTTL", "PERSIST"):
        _arity(n == 2, cmd)
        return [(a[0], "PERSIST" if cmd == "PERSIST" else "TTL", None, None)]
    raise KeyError(cmd)


#: Data commands: those that are answered OK whatever their keys hold, those that leave their keys as they are, and the others.
WRITES, READS = {"SET", "SETEX", "PSETEX", "MSET"}, {"GET", "EXISTS", "MGET", "TTL", "PTTL"}
DATA = WRITES | READS | {"DEL", "INCR", "DECR", "INCRBY", "DECRBY", "EXPIRE", "PEXPIRE", "PERSIST"}
#: Commands whose replies depend on keys.
KEYED = DATA - WRITES | {"SCAN", "DBSIZE"}
#: Those that several keys may answer.
SEVERAL = {"DEL", "EXISTS", "MGET"}


class Session:
    """One connection's state, and what each of its commands becomes."""

    def __init__(self, users: dict[str, tuple[str, frozenset[str]]]):
        self.users, self.user = users, None
        self.subs: dict[str, dict[str, None]] = {"channel": {}, "pattern": {}}
        self.closed = False

    def load(self, items: list[str]) -> list[tuple]:
        """Take up the state that an earlier table of commands ended in; returns its subscriptions as changes."""
        name, closed, channels, *targets = items
        self.user, self.closed = name or None, closed == "1"
        if self.user not in self.users:  # a user who is gone must log in again
            self.user = None
        changes = [(i, "channel" if i < int(channels) else "pattern", t, True) for i, t in enumerate(targets)]
        for _, kind, target, _ in changes:
            self.subs[kind][target] = None
        return changes

    def save(self) -> list[str]:
        return [self.user or "", "1" if self.closed else "0", str(len(self.subs["channel"])), *self.subs["channel"], *self.subs["pattern"]]

    def count(self) -> int:
        return len(self.subs["channel"]) + len(self.subs["pattern"])

    def plan(self, argv: list[str | None], now: int) -> dict:
        """What a command becomes: its answer, its operations, changes of subscriptions, or arguments that wait (``lo``, ``hi``)."""
        row: dict = {}
        try:
            if not argv:
                raise _error("ERR empty command")
            if argv[0] is not None:
                row["cmd"] = argv[0].upper()
            if None in argv:
                raise _error("ERR internal: null argument")
            cmd = row["cmd"]
            if self.count() and cmd not in SUBSCRIBED:
                raise _error(f"ERR Can't execute '{cmd}' in subscribe context, only (P)SUBSCRIBE / (P)UNSUBSCRIBE / PING / QUIT are allowed")
            if self.users and cmd not in OPEN:
                if self.user is None:
                    raise _error("NOAUTH Authentication required.")
                allowed = self.users[self.user][1]
                if allowed and cmd not in allowed:
                    raise _error(f"NOPERM this user has no permissions to run the '{cmd}' command")
            if cmd in DATA:
                row["ops"] = [(i, *op) for i, op in enumerate(operations(cmd, argv, now))]
            else:
                self.other(cmd, argv, row)
        except _Answer as answer:
            row["type"], row["text"], row["num"], row["items"] = answer.row
        return row

    def other(self, cmd: str, argv: list[str], row: dict) -> None:
        n = len(argv)
        if cmd == "AUTH":
            _arity(2 <= n <= 3, cmd)
            if not self.users:
                raise _error("ERR Client sent AUTH, but no password is set. Did you mean AUTH <username> <password>?")
            name, attempt = ("default", argv[1]) if n == 2 else argv[1:]
            if name not in self.users or self.users[name][0] != attempt:
                raise _error("WRONGPASS invalid username-password pair or user is disabled.")
            self.user = name
            raise _Answer("+", "OK")
        if cmd == "PING":
            _arity(n <= 2, cmd)
            raise _Answer("+", "PONG") if n == 1 else _Answer("$", argv[1])
        if cmd == "QUIT":
            self.closed = True
            self.unsubscribe_all(row)
            raise _Answer("+", "OK")
        if cmd == "COMMAND":
            raise _Answer("*", items=[])
        if cmd == "SHUTDOWN":
            raise _Answer("none")
        if cmd in ("SUBSCRIBE", "PSUBSCRIBE", "UNSUBSCRIBE", "PUNSUBSCRIBE"):
            self.subscription(cmd, argv, row)
        if cmd == "SAVE":
            _arity(n == 1, cmd)
            raise _Answer("+", "OK")
        if cmd == "BGSAVE":
            _arity(n <= 2, cmd)
            if n == 2 and argv[1].upper() != "SCHEDULE":
                raise _error(SYNTAX)
            raise _Answer("+", "Background saving started")
        if cmd in ("DBSIZE", "LASTSAVE"):
            _arity(n == 1, cmd)
        elif cmd == "INFO":
            _arity(n <= 2, cmd)
        elif cmd == "PUBLISH":
            _arity(n == 3, cmd)
            row["lo"], row["hi"] = argv[1:]
        elif cmd == "SCAN":
            if n != 3:
                raise _error(SCAN_HELP)
            if argv[1].encode() > argv[2].encode():
                raise _error("ERR the range's start is after its end")
            row["lo"], row["hi"] = argv[1:]
        else:
            raise _error(f"ERR unknown command '{argv[0]}'")

    def subscription(self, cmd: str, argv: list[str], row: dict) -> None:
        kind, add = "pattern" if cmd[0] == "P" else "channel", "UN" not in cmd
        held = self.subs[kind]
        if add:
            _arity(len(argv) >= 2, cmd)
        targets = argv[1:] or list(held)
        out, row["changes"] = [], []
        for i, target in enumerate(targets):
            if add:
                held[target] = None
            else:
                held.pop(target, None)
            row["changes"].append((i, kind, target, add))
            out.append(_frame(cmd.lower(), target, self.count()))
        raise _Answer("raw", "".join(out) or _frame(cmd.lower(), None, 0))

    def unsubscribe_all(self, row: dict) -> None:
        row["changes"] = [(i, k, t, False) for i, (k, t) in enumerate((k, t) for k, held in self.subs.items() for t in held)]
        for held in self.subs.values():
            held.clear()


def _frame(tag: str, target: str | None, count: int) -> str:
    text = "$-1\r\n" if target is None else f"${len(target.encode())}\r\n{target}\r\n"
    return f"*3\r\n${len(tag)}\r\n{tag}\r\n{text}:{count}\r\n"


def plan(commands: DataFrame, users: DataFrame | None = None, sessions: DataFrame | None = None, dealt: bool = False, only: Iterable[str] | None = None) -> DataFrame:
    """Step 1: each command's answer or operations. The users table is collected: it is a configuration of a server.

    Rows ``_LOAD`` and ``_STATE`` carry the state that each session starts from and ends in. ``dealt``: each session's
    commands already lie together and in order in one partition, and are neither shuffled nor sorted again. ``only``: rows that replies of these commands do not
    need are left out (and so are the states).
    """
    whole = only is None or needed_for(only) is None
    shown = frozenset() if whole else frozenset(only) | {"SHUTDOWN"} | (SAVES if "LASTSAVE" in only else set())
    heard, folds = whole or "PUBLISH" in only, whole or bool(KEYED & set(only))
    known = {u["username"]: (u["password"], frozenset(c.upper() for c in u["allowed"] or [])) for u in users.collect()} if users is not None else {}

    names = [c.split()[0] for c in _PLAN.split(", ")]
    text, long = pa.string(), pa.int64()
    kinds = [text, long, long, text, text, text, long, pa.list_(text), pa.int32(), pa.int32(), text, text, text, long]

    def flat(rows: list[tuple], sid: str, seq: int, now: int, row: dict) -> None:
        cmd, ops = row.get("cmd"), row.get("ops")
        if ops is not None:
            size, answer = len(ops), ("+", "OK") if cmd in WRITES else (None, None)
            for op in ops if folds else ops[:1]:
                rows.append((sid, seq, now, cmd, *answer, None, None, size, *op))
                answer = (None, None)
            return
        if whole or cmd in shown:
            rows.append((sid, seq, now, cmd, row.get("type"), row.get("text"), row.get("num"), row.get("items"), None, None, row.get("lo"), None, row.get("hi"), None))
        for pos, kind, target, add in row.get("changes", ()) if heard else ():
            rows.append((sid, seq, now, cmd, "none", None, None, None, None, pos, target, "ADD" if add else "REMOVE", kind, None))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, session, first = None, None, True
        for batch in batches:
            rows: list[tuple] = []
            # the lists of arguments by their ends: a list column is slow to turn into lists itself
            words, ends = listed(batch.column(3).flatten()), np.cumsum(pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy(zero_copy_only=False))
            given = listed(batch.column(3).is_valid())
            starts = np.concatenate([[0], ends[:-1]]).tolist()
            lists = [words[a:b] if ok else None for a, b, ok in zip(starts, ends.tolist(), given, strict=True)]
            for sid, seq, now, argv, state in zip(*(listed(batch.column(i)) for i in range(3)), lists, listed(batch.column(4)), strict=True):
                if first or sid != name:
                    if not first and whole:
                        flat(rows, name, HIGH, 0, {"cmd": "_STATE", "type": "none", "items": session.save()})
                    name, session, first = sid, Session(known), False
                if state:
                    flat(rows, sid, LOW, 0, {"cmd": "_LOAD", "type": "none", "changes": session.load(argv)})
                elif not session.closed:  # what follows QUIT is never read
                    flat(rows, sid, seq, now, session.plan(argv, now))
            if rows:
                yield batch_of(rows)
        if not first and whole:
            flat(last := [], name, HIGH, 0, {"cmd": "_STATE", "type": "none", "items": session.save()})
            yield batch_of(last)

    # a state comes in the arguments' column: a second column of lists, mostly null, takes Spark longer to hand over than all others
    rows = commands.select("session_id", "seq", "ts_ms", "argv", F.lit(False).alias("state"))
    if sessions is not None:
        rows = rows.unionByName(sessions.select("session_id", F.lit(LOW).alias("seq"), F.lit(0).cast("bigint").alias("ts_ms"), F.col("state").alias("argv"), F.lit(True).alias("state")))
    if dealt and sessions is None:
        return rows.mapInArrow(run, _PLAN)
    # sessions differ in length and each is walked by one task: several tasks for each core even this out (more only cost their starts)
    parts = max(int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * commands.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, "session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, _PLAN)


class Interpreted(NamedTuple):
    """Replies, the mutation log they wrote, and the state ``session_id, state`` that each session ended in."""

    replies: DataFrame
    log: DataFrame
    sessions: DataFrame


#: What moves a session or ends all of them.
STATEFUL = {"AUTH", "QUIT", "SHUTDOWN", "SUBSCRIBE", "UNSUBSCRIBE", "PSUBSCRIBE", "PUNSUBSCRIBE"}
SAVES = {"SAVE", "BGSAVE"}


def needed_for(only: Iterable[str]) -> set[str] | None:
    """The commands that replies of ``only`` depend on; None for all (INFO counts every command)."""
    only = set(only)
    if "INFO" in only:
        return None
    return only | STATEFUL | (DATA - READS if only & KEYED else set()) | (SAVES if "LASTSAVE" in only else set())


class Interpreter:
    """One table of commands; what its replies need is worked out when it is first asked for, then kept as stored tables.

    ``before``: the entries that the store starts with. ``info``: the figures that INFO starts from (see stats); commands,
    sessions and buffered bytes are counted up to its place. ``sessions``:
    the states that an earlier table of commands ended in, for sessions that go on. ``dealt``: see plan. ``only``: the
    commands whose replies will be asked for (upper case; None: all); others are walked as far as those depend on them.
    ``names``: the commands that occur (upper case), where the caller knows them.
    """

    def __init__(self, commands: DataFrame, users: DataFrame | None = None, before: DataFrame | None = None, info: dict | None = None, sessions: DataFrame | None = None, dealt: bool = False, only: Iterable[str] | None = None, names: Iterable[str] | None = None):
        self.before, self.info, self.only = before, info or {}, None if only is None else frozenset(only)
        needed = None if only is None else needed_for(self.only)
        if needed is not None and not (names is not None and needed >= set(names)):
            commands = commands.filter(F.upper(F.get("argv", F.lit(0))).isin(sorted(needed)))
        planned, wide = plan(commands, users, sessions, dealt, self.only), {"SCAN", "DBSIZE", "PUBLISH", "LASTSAVE", "INFO"}
        # replies that all come from the walk, or all from the fold, read it once: it goes on to them unstored, if no SHUTDOWN can cut it off
        self.once = needed is not None and names is not None and "SHUTDOWN" not in names and not self.only & wide and (self.only <= KEYED or not self.only & KEYED)
        if self.once:
            self.present, self.several, self.planned, self.sessions = set(), bool(self.only & SEVERAL), planned, None
            return
        # observed while they are written: what else than its own keys some command needs (what does not occur needs no part of the
        # plan), the first SHUTDOWN, and whether a command is answered by several keys
        seen = Observation()
        planned = planned.observe(
            seen, *[F.max(F.col("cmd") == c).alias(c) for c in sorted(wide)], F.min(F.when(F.expr("cmd = 'SHUTDOWN' AND type = 'none'"), F.col("seq"))).alias("stop"), F.max(F.expr("size <> 1 AND op <> 'SET'")).alias("several"),
        )
        planned, found = stored(planned, "planned"), seen.get
        states = planned.filter("cmd = '_STATE'").select("session_id", F.col("items").alias("state"))
        self.present, self.several, stop = {c for c in wide if found[c]}, bool(found["several"]), found["stop"]
        if stop is not None:  # no command after it is read, and all connections are closed
            planned, states = planned.filter(F.col("seq") <= stop), states.limit(0)
        self.planned, self.sessions = planned, states if needed is None else None  # a session may have none of the needed commands

    @cached_property
    def folded(self) -> DataFrame:
        """Step 2. Commands are answered by their operations: session and name go along, ``many`` where there are several.

        Stored, unless only one step reads it: then refused commands pass through it too (their key only deals them).
        """
        waits, refused = F.col("size").isNotNull() & (F.col("op") != "SET"), F.col("size").isNull()
        ops = self.planned.filter("size IS NOT NULL OR type = '-'" if self.once else "size IS NOT NULL").select(
            F.when(refused, F.col("seq").cast("string")).otherwise(F.col("key")).alias("key"), "seq", F.coalesce("pos", F.lit(0)).alias("pos"), "ts_ms", F.when(refused, "REFUSED").otherwise(F.col("op")).alias("op"),
            F.when(refused, F.col("text")).otherwise(F.col("value")).alias("value"), "n", *[F.when(waits | refused, F.col(c)).alias(c) for c in ("session_id", "cmd")], F.when(waits & (F.col("size") > 1), "").alias("many"),
        )
        found = fold.fold(ops, self.before, ("session_id", "cmd", "many"))
        reads = self.only is not None and (self.only <= DATA and not self.several or self.only <= {"SCAN", "DBSIZE"})
        return found if self.once or reads else stored(found, "folded")

    @cached_property
    def log(self) -> DataFrame:
        """The mutation log that the commands write."""
        if self.only is not None and "INFO" not in self.only and not self.only & KEYED:
            raise ValueError(f"walked for {sorted(self.only)} only")
        return fold.mutations_of(self.folded)

    @cached_property
    def held(self) -> DataFrame:
        """The versions of all keys, for SCAN and DBSIZE."""
        return stored(history(self.log, self.before), "held")

    def replies(self, only: Iterable[str] | None = None) -> DataFrame:
        """``session_id, seq, type, text, num, items, resp`` of all commands, or of those named in ``only`` (upper case).

        Each reply is the same either way; steps that no named command depends on are left out of the plan.
        """
        named = self.only if only is None else frozenset(only)
        if self.only is not None and not named <= self.only:
            raise ValueError(f"walked for {sorted(self.only)} only")
        asked = (lambda rows: rows) if named is None else lambda rows: rows.filter(F.col("cmd").isin(sorted(named)))
        wanted = lambda *names: {n for n in names if named is None or n in named}
        planned, present = asked(self.planned), wanted(*self.present)

        def answers(rows: DataFrame, one: Callable[[str], F.Column], total: F.Column, texts: F.Column) -> DataFrame:
            """Replies of KEYED data commands from their first result, their results' sum and all texts."""
            cmd, wrong, number = F.col("cmd"), one("err").isNotNull(), one("num")
            seconds = F.when(number < 0, number).otherwise(F.floor(number / 1000))
            return rows.select(
                "session_id", "seq",
                F.when(wrong, "-").when(cmd == "GET", "$").when(cmd == "MGET", "*").otherwise(":").alias("type"),
                F.when(wrong, one("err")).when(cmd == "GET", one("text")).alias("text"),
                F.when(wrong | cmd.isin("GET", "MGET"), F.lit(None)).when(cmd.isin("DEL", "EXISTS"), total).when(cmd == "TTL", seconds).otherwise(number).cast("bigint").alias("num"),
                F.when(cmd == "MGET", texts).alias("items"),
            )

        parts = [] if self.once and self.only & KEYED else [planned.filter("type IS NOT NULL AND type <> 'none'").select("session_id", "seq", "type", "text", "num", "items")]
        if wanted(*DATA - WRITES):
            done = asked(self.folded.filter("cmd IS NOT NULL"))
            many = self.several and bool(wanted(*SEVERAL))
            if many:  # their operations' results in order
                r = F.array_sort(F.collect_list(F.struct("pos", "num", "text", "err")))
                each = (done if self.once else done.filter("many IS NOT NULL")).groupBy("session_id", "seq", "cmd").agg(r.alias("r"))
                total = F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + x["num"])
                parts.append(answers(each, lambda c: F.col("r")[0][c], total, F.transform("r", lambda x: x["text"])))
            if not (many and self.once):
                parts.append(answers(done.filter("many IS NULL"), F.col, F.col("num"), F.array("text")))
        open_rows = planned.filter("type IS NULL AND size IS NULL").withColumnsRenamed({"key": "lo", "value": "hi"})
        number, text, items = F.lit(None).cast("bigint"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")

        def add(rows: DataFrame, kind: str, **more: F.Column) -> None:
            found = {"type": F.lit(kind), "text": text, "num": number, "items": items} | more
            parts.append(rows.select("session_id", "seq", *[c.alias(n) for n, c in found.items()]))

        if "SCAN" in present:  # reads of many keys, as of their place in the order
            scans = open_rows.filter("cmd = 'SCAN'").select("session_id", "seq", "ts_ms", "lo", "hi")
            pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
            found = sizes.scan_at(self.held, scans).groupBy("seq").agg(F.flatten(F.transform(pairs, lambda e: F.array(e["key"], e["value"]))).alias("found"))
            add(scans.join(found, "seq", "left"), "*", items=F.coalesce("found", F.array().cast("array<string>")))
        if "DBSIZE" in present:
            sized = open_rows.filter("cmd = 'DBSIZE'").select("session_id", "seq", "ts_ms")
            add(sized.join(sizes.dbsize_at(self.held, sized), "seq", "left"), ":", num=F.coalesce("dbsize", F.lit(0)).cast("bigint"))
        if "PUBLISH" in present:  # receivers at that moment
            changes = self.planned.filter("op IS NOT NULL AND size IS NULL").select(F.col("session_id").alias("conn"), "seq", "pos", F.col("value").alias("kind"), F.col("key").alias("target"), (F.col("op") == "ADD").alias("add"))
            messages = open_rows.filter("cmd = 'PUBLISH'").select(F.col("seq").alias("msg_id"), "session_id", "seq", F.col("lo").alias("channel"), F.col("hi").alias("payload"))
            counted = pubsub.publish_counts(messages, stored(pubsub.intervals(changes), "subscribed"), tasks_for(self.planned, SHARE))
            add(messages.join(counted, "msg_id"), ":", num=F.col("receivers").cast("bigint"))
        if "LASTSAVE" in present:  # the newest save before it
            saves = self.planned.filter("cmd IN ('SAVE', 'BGSAVE') AND type = '+'").select("seq", F.floor(F.col("ts_ms") / 1000).alias("at"))
            points = open_rows.filter("cmd = 'LASTSAVE'").select("session_id", "seq")
            add(points.join(last_before(points.select("seq"), saves), "seq", "left"), ":", num=F.coalesce("at", F.lit(0)).cast("bigint"))
        if "INFO" in present:
            zero = F.lit(0).cast("bigint")
            came = self.planned.filter("(cmd NOT IN ('_LOAD', '_STATE') OR cmd IS NULL) AND (op IS NULL OR size IS NOT NULL AND pos = 0)").select("session_id", "seq")
            events = came.select("seq", F.lit(1).cast("bigint").alias("total_commands_processed"), zero.alias("total_connections_received"), zero.alias("memtable_bytes"))
            events = events.unionByName(came.groupBy("session_id").agg(F.min("seq").alias("seq")).select("seq", zero.alias("total_commands_processed"), F.lit(1).cast("bigint").alias("total_connections_received"), zero.alias("memtable_bytes")))
            wrote = F.when(F.col("op") == DEL, entry_bytes(F.col("key"), F.lit(None).cast("string"))).otherwise(entry_bytes(F.col("key"), F.col("value")))
            events = events.unionByName(self.log.select("seq", zero.alias("total_commands_processed"), zero.alias("total_connections_received"), wrote.cast("bigint").alias("memtable_bytes")))
            points = open_rows.filter("cmd = 'INFO'").select("session_id", "seq")
            add(points.join(stats.info_at(points.select("seq"), events, self.info).withColumnRenamed("text", "found"), "seq"), "$", text=F.col("found"))

        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.withColumn("resp", resp.reply(F.col("type"), F.col("text"), F.col("num"), F.col("items")))


def interpret(commands: DataFrame, users: DataFrame | None = None, before: DataFrame | None = None, info: dict | None = None, sessions: DataFrame | None = None) -> Interpreted:
    """Replies of all commands, the mutation log they write, and the sessions' last states (see Interpreter).

    Replies are ``session_id, seq, type, text, num, items, resp``; nothing for SHUTDOWN, after it and after QUIT.
    """
    found = Interpreter(commands, users, before, info, sessions)
    return Interpreted(found.replies(), found.log, found.sessions)


def history(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The versions of every key that a log ``seq, pos, ...`` makes, after the entries ``before``."""
    writes = log.select("seq", "pos", "op", "key", "value", "expires_at_ms")
    if before is not None:
        writes = writes.unionByName(before.select(F.lit(LOW).alias("seq"), F.lit(0).alias("pos"), F.lit("PUT").alias("op"), "key", "value", "expires_at_ms"))
    order = Window.partitionBy("key").orderBy("seq", "pos")
    found = writes.select("key", F.col("seq").alias("seq_from"), F.lead("seq", 1, NEVER).over(order).alias("seq_to"), "op", "value", "expires_at_ms")
    return found.filter("seq_from < seq_to")  # MSET may write a key twice: its last write there counts


def last_before(points: DataFrame, events: DataFrame, span: int = 100_000) -> DataFrame:
    """``seq, at`` of each point: the value of the newest of ``events (seq, at)`` before it, null if there is none.

    Ranges of ``span`` sequence numbers are walked apart; what a range starts with comes from a table of one
    row for each range (see carry), so no task sees all rows.
    """
    rows = points.select("seq", F.lit(None).cast("bigint").alias("at"), F.lit(True).alias("ask"))
    rows = rows.unionByName(events.select("seq", F.col("at").cast("bigint").alias("at"), F.lit(False).alias("ask"))).withColumn("_range", F.floor(F.col("seq") / span))
    starts = carried(rows.groupBy("_range").agg(F.max_by("at", F.when(~F.col("ask"), F.col("seq"))).alias("_end")), "last")
    within = Window.partitionBy("_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.join(starts, "_range").withColumn("at", F.coalesce(F.last("at", ignorenulls=True).over(within), F.col("_start")))
    return seen.filter("ask").select("seq", "at")


def state_after(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The newest entry of each key after a log, deletes included: ``key, value, expires_at_ms, op``."""
    rows = log.select(F.struct("seq", "pos").alias("seq"), "op", "key", "value", "expires_at_ms")
    if before is not None:
        rows = rows.unionByName(before.select(F.struct(F.lit(LOW).alias("seq"), F.lit(0).alias("pos")).alias("seq"), F.lit("PUT").alias("op"), "key", "value", "expires_at_ms"))
    return latest_per_key(rows).select("key", "value", "expires_at_ms", "op")
