"""Server and storage figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entry_bytes
from ..schema import DEL
from .carry import carried, sums_at


def memtable_bytes(mutations: DataFrame) -> DataFrame:
    """Accounted bytes of a buffer that has taken these writes: each counts its key and value, deletes the key alone."""
    size = F.when(F.col("op") == DEL, entry_bytes(F.col("key"), F.lit(None).cast("string"))).otherwise(entry_bytes(F.col("key"), F.col("value")))
    return mutations.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("memtable_bytes"))


def dbsize_approx(run_entries: int, buffered_bytes: int) -> int:
    """The size heuristic: entries of all runs (deletes and hidden versions too) and a fiftieth of the buffered bytes."""
    return run_entries + max(0, buffered_bytes // 50)


def dbsize_figure(run_entries: DataFrame, buffered: DataFrame) -> DataFrame:
    """``dbsize``: dbsize_approx() of a row ``n`` and a row ``memtable_bytes``."""
    both = run_entries.crossJoin(buffered)  # one row each
    return both.select((F.col("n") + F.greatest(F.lit(0), F.floor(F.col("memtable_bytes") / 50))).cast("bigint").alias("dbsize"))


def peak_connections(events: DataFrame) -> DataFrame:
    """The most connections open at once, of ``day, seq, step`` (+1 opens, -1 closes).

    Days are summed apart, then a day's start is what the days before left open (see carry).
    """
    within = Window.partitionBy("day").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    daily = events.withColumn("open", F.sum("step").over(within)).groupBy("day").agg(F.max("open").alias("top"), F.sum("step").alias("net"))
    start = carried(daily.select(F.col("day").alias("_range"), F.col("net").alias("_end")), "sum")
    return daily.join(start, F.col("day") == F.col("_range")).agg(F.max(F.col("_start") + F.col("top")).cast("bigint").alias("peak"))


def info_text(f: dict, product: str = "keelstone") -> str:
    """The five sections of INFO; missing figures are 0. ``max_connections`` 0 means unlimited.

    ``product`` begins the name of the version field, so clients of another server can be given theirs.
    """
    g = lambda k: f.get(k, 0)
    hits, misses = g("block_cache_hits"), g("block_cache_misses")
    rate = hits / (hits + misses) if hits + misses else 0.0
    sections = {
        "server": [f"{product}_version:{f.get('version', '0.1.0')}", f"uptime_in_seconds:{g('uptime_in_seconds')}", f"process_id:{g('process_id')}"],
        "stats": [f"{k}:{g(k)}" for k in ("total_commands_processed", "total_connections_received", "connected_clients", "rejected_connections", "peak_concurrent_connections")],
        "storage": [f"{k}:{g(k)}" for k in ("memtable_bytes", "sstable_count", "sstable_total_bytes", "last_snapshot_epoch_sec", "dbsize_approx")],
        "cache": [f"block_cache_size:{g('block_cache_size')}", f"block_cache_capacity:{f.get('block_cache_capacity', 1024)}", f"block_cache_hits:{hits}", f"block_cache_misses:{misses}", f"block_cache_hit_rate:{rate:.4f}"],
        "limits": [f"max_connections:{g('max_connections') or 'unlimited'}"],
    }
    return "\n".join("\n".join([f"# {name}", *lines, ""]) for name, lines in sections.items())


#: INFO's figures that change within a table of commands.
MOVING = ("total_commands_processed", "total_connections_received", "memtable_bytes")


def info_at(points: DataFrame, events: DataFrame, figures: dict, span: int = 100_000) -> DataFrame:
    """``seq, text``: what INFO answers at each ``seq``.

    ``events``: rows ``seq`` and the MOVING figures that they add; ``figures``: all figures before the first.
    """
    marks = {c: f"\x01{c}\x01" for c in MOVING}  # no figure's text holds the control character
    text = F.lit(info_text(figures | marks))
    for c, mark in marks.items():
        text = F.replace(text, F.lit(mark), (F.col(c) + F.lit(int(figures.get(c, 0)))).cast("string"))
    return sums_at(points, events, list(MOVING), span).select("seq", text.alias("text"))


def storage_figures(commands: DataFrame, mutations: DataFrame) -> DataFrame:
    """One row of counts for INFO from tables of commands and mutations."""
    a = commands.agg(F.count(F.lit(1)).alias("total_commands_processed"), F.count_distinct("session_id").alias("total_connections_received"))
    return a.crossJoin(memtable_bytes(mutations))  # one row each
