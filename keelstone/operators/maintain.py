"""Compaction, snapshots and their policies, as rewrites of Parquet in key order."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import entry_bytes, file_name
from ..schema import DEL, MUTATIONS
from .resolve import latest_per_key, live, not_expired

#: Files at level 0 that start a compaction, bytes of level 1, its growth by level, an output file's bytes.
LEVEL0_FILES, LEVEL1_BYTES, LEVEL_GROWTH, OUTPUT_BYTES = 4, 10 << 20, 10, 2 << 20


def level_limit(level: int) -> int:
    """Bytes that a level may hold; level 0 is limited by files."""
    return LEVEL1_BYTES * LEVEL_GROWTH ** max(0, level - 1)


def compacted(mutations: DataFrame, now_ms: int | None = None) -> DataFrame:
    """One row for each key. With ``now_ms`` deletes and expired entries go, which is right only if the log
    holds all there is; without it they stay, as older runs may still have what they hide."""
    newest = latest_per_key(mutations)
    return newest if now_ms is None else newest.filter((F.col("op") != DEL) & not_expired(now_ms))


def write_run(rows: DataFrame, path: str, partitions: int | None = None, records: int = 2_000_000, mode: str = "errorifexists") -> None:
    """Write rows as runs of disjoint key ranges, sorted, so that a point or range read skips row groups by their bounds."""
    ranged = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
    ranged.sortWithinPartitions("key").write.mode(mode).option("maxRecordsPerFile", records).option("parquet.bloom.filter.enabled#key", "true").option("compression", "zstd").parquet(path)


def compact(mutations: DataFrame, path: str, now_ms: int | None = None, partitions: int | None = None) -> DataFrame:
    """Rewrite a log as a sorted run in a new folder and return it; readers of the old files are never disturbed."""
    write_run(compacted(mutations, now_ms), path, partitions)
    return mutations.sparkSession.read.schema(MUTATIONS).parquet(path)


def run_ranges(rows: DataFrame, bucket: str) -> DataFrame:
    """Least and greatest key, and the number of keys, of each run."""
    return rows.groupBy(bucket).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n_keys"))


def overlapping(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """Files ``name, min_key, max_key`` that meet the key range of all ``inputs`` together."""
    span = inputs.agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))  # one row
    return files.join(F.broadcast(span), (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi"))).drop("lo", "hi")


def level_bytes(files: DataFrame) -> DataFrame:
    """Files and bytes of each level of ``level, bytes``, and whether it is due for compaction."""
    total = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    limit = F.lit(LEVEL1_BYTES) * F.pow(F.lit(LEVEL_GROWTH), F.greatest(F.lit(0), F.col("level") - 1))
    return total.withColumn("due", F.when(F.col("level") == 0, F.col("files") >= LEVEL0_FILES).otherwise(F.col("bytes") > limit))


def pick(files: DataFrame) -> DataFrame:
    """The files ``name, level, seq, bytes`` that the next compaction of each due level takes: all of level 0, else the oldest."""
    due = level_bytes(files).filter("due").select("level")
    oldest = files.groupBy("level").agg(F.min("seq").alias("_oldest"))  # one row a level
    chosen = files.join(due, "level").join(oldest, "level").filter((F.col("level") == 0) | (F.col("seq") == F.col("_oldest")))
    return chosen.select("name", "level", "seq", "bytes")


def output_chunks(rows: DataFrame, limit: int = OUTPUT_BYTES, run: str = "run") -> DataFrame:
    """Add ``chunk``: a run's rows in key order, cut once a chunk has reached ``limit`` accounted bytes.

    The count starts again after each cut, which no window frame can say, so each run is walked in order.
    """
    sized = rows.withColumn("_bytes", entry_bytes(F.col("key"), F.col("value")))
    schema = StructType([*rows.schema.fields, StructField("chunk", IntegerType())])
    width = len(rows.columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, held = None, 0, 0
        for batch in batches:
            out = []
            for name, n in zip(batch.column(run).to_pylist(), batch.column("_bytes").to_pylist(), strict=True):
                if name != now:
                    now, chunk, held = name, 0, 0
                elif held >= limit:
                    chunk, held = chunk + 1, 0
                held += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, pa.int32())], names=[*batch.schema.names[:width], "chunk"])

    return sized.repartition(run).sortWithinPartitions(run, "key").mapInArrow(walk, schema)


def run_files(rows: DataFrame) -> DataFrame:
    """``name, level, number, min_key, max_key, bytes`` of the files that rows ``file, level, number, key, value, ...`` lie in."""
    size = F.sum(entry_bytes(F.col("key"), F.col("value")))
    return rows.groupBy(F.col("file").alias("name"), "level", "number").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), size.alias("bytes"))


def compact_level(rows: DataFrame, now_ms: int, limit: int = OUTPUT_BYTES, partitions: int | None = None) -> DataFrame | None:
    """One compaction of leveled runs ``file, level, number`` and mutation columns; None if no level is due.

    The picked files and the files of the next level that they overlap become new files of that level; all other rows
    stay as they are. The deepest due level goes first, but level 0 before any other. Deletes and expired entries
    go only if no deeper level holds files and none stays that they may hide. Files are cut at ``limit`` accounted bytes.
    """
    files = run_files(rows).checkpoint()
    due = [r["level"] for r in level_bytes(files).filter("due").select("level").collect()]  # a row a level
    if not due:
        return None
    level = 0 if 0 in due else max(due)
    picked = pick(files.filter(F.col("level") == level).withColumnRenamed("number", "seq")).select("name")
    inputs = files.join(picked, "name")
    below = files.filter(F.col("level") == level + 1)
    # with deeper files, or files of the level above them that are not picked, a tombstone still hides something
    deepest = files.agg(F.max("level")).first()[0] <= level + 1
    first = files.agg(F.max("number")).first()[0] + 1
    taken = inputs.select("name").unionByName(overlapping(below, inputs).select("name")).distinct().checkpoint()
    old = rows.join(taken, F.col("file") == F.col("name"), "left_semi")
    merged = compacted(old.drop("file", "level", "number"), now_ms if deepest else None)
    ranged = (merged.repartitionByRange(partitions, "key") if partitions else merged.repartitionByRange("key")).withColumn("part", F.spark_partition_id())
    cut = output_chunks(ranged, limit, "part")
    number = F.lit(first) + F.col("part").cast("bigint") * 1_000_000 + F.col("chunk")
    new = cut.withColumn("number", number).withColumn("level", F.lit(level + 1)).withColumn("file", file_name(F.col("level"), F.col("number")))
    kept = rows.join(taken, F.col("file") == F.col("name"), "left_anti")
    return kept.unionByName(new.select(*[F.col(c).cast(kept.schema[c].dataType) for c in kept.columns]))


def snapshot(mutations: DataFrame, folder: str, now_ms: int, upto_seq: int | None = None, mode: str = "errorifexists") -> str:
    """Write the live view as ``snapshot-<13-digit ms>.db`` and return its path; ``upto_seq`` fixes the point in the log."""
    log = mutations if upto_seq is None else mutations.filter(F.col("seq") <= upto_seq)
    path = f"{folder.rstrip('/')}/snapshot-{now_ms:013d}.db"
    write_run(live(log, now_ms), path, mode=mode)
    return path


def restore(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot as the oldest rows of a log: ``seq`` 0 and below everything written later."""
    view = spark.read.parquet(path)
    return view.select(F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("ts_ms"), F.lit("PUT").alias("op"), "key", "value", "expires_at_ms")


class Snapshots:
    """Snapshots in the background: one at a time, and a request during a run joins that run."""

    def __init__(self):
        self._pool, self._lock = ThreadPoolExecutor(1), Lock()
        self._running: Future | None = None
        self.last_epoch_sec = 0

    def save(self, mutations: DataFrame, folder: str, now_ms: int, upto_seq: int | None = None, mode: str = "errorifexists") -> str:
        path = snapshot(mutations, folder, now_ms, upto_seq, mode)
        self.last_epoch_sec = now_ms // 1000
        return path

    def bgsave(self, mutations: DataFrame, folder: str, now_ms: int, upto_seq: int | None = None) -> Future:
        with self._lock:
            if self._running is None or self._running.done():
                self._running = self._pool.submit(self.save, mutations, folder, now_ms, upto_seq)
            return self._running

    def close(self) -> None:
        self._pool.shutdown(wait=True)
