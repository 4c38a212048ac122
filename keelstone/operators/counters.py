"""Counters and chained expiries by windows: for logs in which no command's text or overflow can fail.

``fold`` has the exact form for any log; these stay inside generated code and suit bulk counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NEVER


def running(increments: DataFrame) -> DataFrame:
    """``seq, key, result`` of each increment ``seq, key, delta`` in a log of increments only."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return increments.select("seq", "key", F.sum("delta").over(w).alias("result"))


def running_with_resets(commands: DataFrame) -> DataFrame:
    """The same where SET (with an integer text) and DEL rows restart a key's count."""
    by_key = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    reset = F.col("cmd").isin("SET", "DEL")
    marked = commands.withColumn("_island", F.sum(reset.cast("int")).over(by_key))
    within = Window.partitionBy("key", "_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("cmd") == "SET", F.col("value").try_cast("bigint")).when(F.col("cmd") == "DEL", F.lit(0)).otherwise(F.col("delta"))
    out = marked.withColumn("result", F.sum(step).over(within))
    return out.filter(~reset).select("seq", "key", "result")


def totals(increments: DataFrame) -> DataFrame:
    """Each key's final count; partial sums before the shuffle, so a hot counter is no hot task."""
    return increments.groupBy("key").agg(F.sum("delta").alias("total"))


def expire_chain(commands: DataFrame) -> DataFrame:
    """``seq, key, result`` (1 or 0) of each PEXPIRE in a log of SET, DEL and PEXPIRE on string keys.

    An expiry works if the key is live at that moment, which depends on the expiries before it: within the run
    since the last SET or DEL, the key is dead once any expiry came too late for the one before.
    """
    by_key = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("cmd").isin("SET", "DEL")
    candidate = (
        F.when(F.col("cmd") == "DEL", F.lit(0))
        .when((F.col("cmd") == "SET") & F.col("ttl_ms").isNull(), F.lit(NEVER))
        .otherwise(F.try_add("ts_ms", "ttl_ms"))
    )
    marked = commands.withColumn("_island", F.sum(starts.cast("int")).over(by_key)).withColumn("_until", candidate)
    within = Window.partitionBy("key", "_island").orderBy("seq")
    marked = marked.withColumn("_before", F.lag("_until").over(within))
    late = (~starts & (F.col("_before").isNull() | (F.col("ts_ms") >= F.col("_before")))).cast("int")
    dead = F.max(late).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("result", 1 - dead).filter(F.col("cmd") == "PEXPIRE").select("seq", "key", "result")
