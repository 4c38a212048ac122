"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.operators import fold, lookup, maintain, resolve, sizes
from keelstone.plans import catalogue
from keelstone.schema import NEVER
from keelstone.session import prepare, scratch, table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def lineitem_log(spark: SparkSession) -> DataFrame:
    """600K writes at sf0.1: one PUT for each line item on its part's key."""
    li = table(spark, SF_DIR, "lineitem")
    key = F.concat(F.lit("part:"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.lit(0).cast("bigint").alias("ts_ms"), F.lit("PUT").alias("op"), key.alias("key"), F.concat_ws("|", "l_quantity", "l_shipdate").alias("value"), F.lit(NEVER).alias("expires_at_ms"))


def resolve_rows(spark: SparkSession) -> tuple[DataFrame, int]:
    log = lineitem_log(spark)
    return resolve.live(log, 0), table(spark, SF_DIR, "lineitem").count()


_BASE: list[DataFrame] = []


def base(spark: SparkSession) -> DataFrame:
    """The live view of a compacted store: reads are timed against data at rest, as a key-value store is read."""
    if not _BASE:
        path = scratch(spark, "bench-base")
        maintain.compact(lineitem_log(spark), path, 0)
        _BASE.append(spark.read.parquet(path).select("key", "value"))
    return _BASE[0]


def batch_lookup(spark: SparkSession) -> tuple[DataFrame, int]:
    """150K requests of four keys each at sf0.1."""
    orders = table(spark, SF_DIR, "orders")
    key = lambda a: F.concat(F.lit("part:"), F.lpad((F.col("o_custkey") * a % 25_000).cast("string"), 8, "0"))
    asked = orders.select(F.col("o_orderkey").alias("request_id"), F.array(*[key(a) for a in (1, 3, 7, 11)]).alias("keys"))
    return lookup.mget(base(spark), asked), 4 * orders.count()


def range_scan(spark: SparkSession) -> tuple[DataFrame, Callable[[], int]]:
    """A scan of 100 keys for each customer; the keys returned are counted."""
    c = table(spark, SF_DIR, "customer")
    start = F.col("c_custkey") % 19_900
    name = lambda n: F.concat(F.lit("part:"), F.lpad(n.cast("string"), 8, "0"))
    found = sizes.scan_many(base(spark), c.select(F.col("c_custkey").alias("request_id"), name(start).alias("lo"), name(start + 100).alias("hi")))
    return found, found.count


def counter_fold(spark: SparkSession) -> tuple[DataFrame, int]:
    li = table(spark, SF_DIR, "lineitem")
    ops = li.select(F.concat(F.lit("n:"), F.col("l_partkey").cast("string")).alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.lit(0).alias("pos"), F.lit(1).cast("bigint").alias("ts_ms"), F.lit("INCR").alias("op"), F.lit(None).cast("string").alias("value"), F.col("l_quantity").cast("bigint").alias("n"))
    return fold.fold(ops), li.count()


def command_replay(spark: SparkSession) -> tuple[DataFrame, int]:
    return catalogue.QUERIES["command_replies"](spark, SF_DIR), catalogue.fixture_commands(spark, SF_DIR).count()


def compaction(spark: SparkSession) -> tuple[DataFrame, int]:
    return maintain.compact(lineitem_log(spark), scratch(spark, "bench"), 0), table(spark, SF_DIR, "lineitem").count()


def window_counters(spark: SparkSession) -> tuple[DataFrame, int]:
    return catalogue.QUERIES["lineitem_counters"](spark, SF_DIR), table(spark, SF_DIR, "lineitem").count()


CASES = {"latest_per_key": resolve_rows, "batch_mget": batch_lookup, "range_scan": range_scan, "counter_fold_exact": counter_fold, "counter_totals": window_counters, "command_replay": command_replay, "compaction": compaction}


def main() -> None:
    spark = prepare(
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    for name, case in CASES.items():
        best = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            df, rows = case(spark)
            df.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        rows = rows() if callable(rows) else rows  # what a scan returned is counted after the clock has stopped
        seconds[name], rates[name] = round(best, 3), round(rows / best)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows_per_sec": rates, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
