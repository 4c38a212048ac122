"""A store in a folder: the library's methods over a mutation log in Parquet.

Each call is a Spark job; bulk work belongs in ``write`` and ``execute``, which take tables.
"""

from __future__ import annotations

import time
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import commands as interpreter
from .operators import fold, lookup, maintain, resolve, stats
from .schema import DEL, MUTATIONS, NEVER, PUT
from .session import prepare
from .sources import runs


class KeyValueStore:
    """Put, get, scan, count, compact and snapshot; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, clock=lambda: int(time.time() * 1000)):
        self.spark, self.path, self.clock = prepare(spark), path.rstrip("/"), clock
        self.snapshots = maintain.Snapshots()
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.snapshots.last_epoch_sec = max([0, *(int(n[9:22]) // 1000 for n in self._finished() if n.startswith("snapshot-") and n[9:22].isdigit())])
        self._seq: int | None = None
        self._sessions: DataFrame | None = None  # of execute(): logins and subscriptions last from call to call

    # -- files: base-<n> (compacted) and every delta-<m> with m > n ----------------------------------------

    def _finished(self) -> list[str]:
        """Names of the folders whose write has been committed."""
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        if not self._fs.exists(jvm_path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(jvm_path(self.path))]
        return [n for n in names if self._fs.exists(jvm_path(f"{self.path}/{n}/_SUCCESS"))]

    def _names(self, kind: str) -> list[int]:
        return sorted(int(n.rsplit("-", 1)[1]) for n in self._finished() if n.startswith(kind + "-"))

    def log(self) -> DataFrame:
        """The log: the newest base and what was written after it."""
        base = self._names("base")[-1:]
        parts = [f"{self.path}/base-{n:09d}" for n in base] + [f"{self.path}/delta-{n:09d}" for n in self._names("delta") if not base or n > base[0]]
        if not parts:
            return self.spark.createDataFrame([], MUTATIONS)
        return self.spark.read.schema(MUTATIONS).parquet(*parts)

    def _next(self) -> int:
        if self._seq is None:
            self._seq = self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        self._seq += 1
        return self._seq

    def write(self, rows: DataFrame) -> None:
        """Append rows ``op, key, value, expires_at_ms`` whose ``seq`` is above all before; an atomic commit."""
        number = max([0, *self._names("delta"), *self._names("base")]) + 1
        rows.select(*[c.split()[0] for c in MUTATIONS.split(", ")]).write.parquet(f"{self.path}/delta-{number:09d}")
        self._seq = None

    def take_over(self, folder: str) -> None:
        """Write what a raw data folder holds (runs and logs of the single-node program) as this store's newest rows."""
        first = self._next()
        newest = resolve.latest_per_key(runs.read_folder(self.spark, folder))
        self.write(newest.withColumn("seq", F.lit(first).cast("bigint")).withColumn("ts_ms", F.lit(self.clock()).cast("bigint")))

    def _append(self, op: str, key: str, value: str | None, until: int) -> None:
        if key is None or (op == PUT and value is None):
            raise ValueError("keys and values must not be null")
        self.write(self.spark.createDataFrame([(self._next(), self.clock(), op, key, value, until)], MUTATIONS))

    # -- the library's methods ------------------------------------------------------------------------------

    def put(self, key: str, value: str, expires_at_ms: int = NEVER) -> None:
        self._append(PUT, key, value, expires_at_ms)

    def delete(self, key: str) -> None:
        self._append(DEL, key, None, NEVER)

    def _step(self, key: str, op: str, n: int | None = None):
        row = resolve.latest_per_key(self.log().filter(F.col("key") == key)).first()
        state = None if row is None or row["op"] == DEL else (row["value"], row["expires_at_ms"])
        state, changed, num, _, err = fold.step(state, op, self.clock(), None, n)
        if err == fold.NOT_INTEGER:
            raise ValueError(err)
        if err:
            raise OverflowError(err)
        if changed:
            self._append(DEL if state is None else PUT, key, *(state or (None, NEVER)))
        return num

    def delete_if_present(self, key: str) -> bool:
        return bool(self._step(key, "DEL"))

    def expire(self, key: str, expires_at_ms: int) -> bool:
        return bool(self._step(key, "EXPIRE", expires_at_ms))

    def persist(self, key: str) -> bool:
        return bool(self._step(key, "PERSIST"))

    def ttl(self, key: str) -> int:
        return self._step(key, "TTL")

    def increment_by(self, key: str, delta: int) -> int:
        return self._step(key, "INCR", delta)

    def view(self) -> DataFrame:
        return resolve.live(self.log(), self.clock())

    def get(self, key: str) -> str | None:
        row = lookup.get(self.view(), key).first()
        return None if row is None else row["value"]

    def scan(self, start: str, end: str) -> DataFrame:
        return lookup.scan(self.view(), start, end)

    def dbsize(self) -> int:
        return self.view().count()

    def execute(self, table: DataFrame, users: DataFrame | None = None) -> DataFrame:
        """Interpret a table of commands, append what they write, return their replies."""
        buffered = stats.memtable_bytes(self.log()).first()[0]
        figures = {"memtable_bytes": buffered, "last_snapshot_epoch_sec": self.snapshots.last_epoch_sec}
        before = resolve.latest_per_key(self.log()).filter(F.col("op") != DEL)
        replies, log, self._sessions = interpreter.interpret(table, users, before, figures, self._sessions)
        self._save_asked(table, replies, log, before)
        newest = interpreter.state_after(log)
        first = self._next()
        # after the batch only each key's newest write matters to later readers, so all share one number
        self.write(newest.select(F.lit(first).alias("seq"), F.lit(self.clock()).alias("ts_ms"), "op", "key", "value", "expires_at_ms"))
        return replies

    def _save_asked(self, table: DataFrame, replies: DataFrame, log: DataFrame, before: DataFrame) -> None:
        """Write a snapshot as of each SAVE and BGSAVE that was accepted; of those of one millisecond, the last."""
        asked = table.filter(F.upper(F.get("argv", F.lit(0))).isin("SAVE", "BGSAVE"))
        if asked.isEmpty():
            return
        done = asked.select("session_id", "seq", "ts_ms").join(replies.filter("type = '+'").select("session_id", "seq"), ["session_id", "seq"])
        for at in done.groupBy("ts_ms").agg(F.max("seq").alias("seq")).orderBy("seq").collect():
            state = interpreter.state_after(log.filter(F.col("seq") <= at["seq"]), before)
            self.snapshots.save(state.withColumn("seq", F.lit(at["seq"])), self.path, at["ts_ms"], mode="overwrite")

    def compact(self, partitions: int | None = None) -> None:
        """Fold everything into a new base in key order; deletes and expired entries go."""
        number = max([0, *self._names("delta"), *self._names("base")])
        maintain.write_run(maintain.compacted(self.log(), self.clock()), f"{self.path}/base-{number + 1:09d}", partitions)

    def compact_due(self, partitions: int | None = None) -> bool:
        """Compact if as many deltas have come since the newest base as start a compaction; whether it did."""
        base = self._names("base")[-1:]
        if sum(not base or n > base[0] for n in self._names("delta")) < maintain.LEVEL0_FILES:
            return False
        self.compact(partitions)
        return True

    def vacuum(self) -> list[str]:
        """Delete the folders that the newest base has replaced; tables that were read before must not be in use."""
        base = self._names("base")[-1:]
        gone = [n for n in self._finished() if base and n.startswith(("base-", "delta-")) and int(n.rsplit("-", 1)[1]) < base[0]]
        for name in gone:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
        return sorted(gone)

    def snapshot(self) -> str:
        return self.snapshots.save(self.log(), self.path, self.clock())

    def bgsnapshot(self) -> Future:
        return self.snapshots.bgsave(self.log(), self.path, self.clock())

    def last_snapshot_epoch_sec(self) -> int:
        return self.snapshots.last_epoch_sec

    def files(self) -> DataFrame:
        """``file, level, rows, bytes`` of the log's files."""
        meta = self.log().select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return meta.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes")).withColumn("level", F.when(F.col("file").contains("/base-"), 1).otherwise(0))

    def close(self) -> None:
        self.snapshots.close()
