"""Reads over the mutation log: newest version of each key, live view, version intervals, reads as of a point.

All of them partition by ``key`` only, so a log that is range-partitioned or bucketed by key keeps its
layout, and filters on ``key`` go through the window into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEL, NEVER


def latest_per_key(mutations: DataFrame) -> DataFrame:
    """The newest mutation of each key, tombstones included.

    A ranked window, as Spark then drops all but each task's first row of a key before the shuffle
    (WindowGroupLimit): a hot key sends one row from each task.
    """
    w = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return mutations.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def not_expired(now_ms: int | Column) -> Column:
    """An entry is gone from the millisecond it expires at."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return F.col("expires_at_ms") > now


def live(mutations: DataFrame, now_ms: int) -> DataFrame:
    """``key, value, expires_at_ms`` of what a reader sees at ``now_ms``."""
    return latest_per_key(mutations).filter((F.col("op") != DEL) & not_expired(now_ms)).select("key", "value", "expires_at_ms")


def tombstones(mutations: DataFrame) -> DataFrame:
    """Keys whose newest mutation is a delete."""
    return latest_per_key(mutations).filter(F.col("op") == DEL).select("key", "seq")


def versions(mutations: DataFrame) -> DataFrame:
    """Each mutation with the half-open interval of sequence numbers in which it is the newest of its key."""
    w = Window.partitionBy("key").orderBy("seq")
    return mutations.select("key", F.col("seq").alias("seq_from"), F.lead("seq", 1, NEVER).over(w).alias("seq_to"), "op", "value", "expires_at_ms")


def as_of(versions_df: DataFrame, requests: DataFrame) -> DataFrame:
    """What each request ``(request_id, key, at_seq, now_ms)`` reads: one row each, value null if absent.

    Versions and requests of a key are walked together in order, and a request takes the last version before it: one
    sort by key, whatever the number of versions and requests that a key has.
    """
    v = versions_df.select("key", F.col("seq_from").alias("at_seq"), F.struct("seq_to", "op", "value", "expires_at_ms").alias("_v"), F.lit(None).cast("bigint").alias("now_ms"), F.lit(False).alias("_ask"))
    asked = requests.select("key", "at_seq", F.col("now_ms").cast("bigint").alias("now_ms"), "request_id", F.lit(True).alias("_ask"))
    rows = v.unionByName(asked, allowMissingColumns=True)
    near = Window.partitionBy("key").orderBy("at_seq", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(near)).filter("_ask")
    hit = (F.col("_v.op") != DEL) & (F.col("at_seq") < F.col("_v.seq_to")) & (F.col("_v.expires_at_ms") > F.col("now_ms"))
    return seen.select("request_id", "key", "at_seq", F.when(hit, F.col("_v.value")).alias("value"))


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Several sorted runs or log segments as one log; precedence stays with ``seq``."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return latest_per_key(out)
