"""Live-key counts and range scans as of many points of a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..schema import NEVER
from ..session import stored
from .carry import FEW, carried, ranged
from .resolve import as_of

#: Sequence numbers in a range; key ranges at most, and keys sampled for each; numbers of one scan in a row.
SPAN, RANGES, SAMPLED, BLOCK = 100_000, 4096, 16, 10_000
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def clocked(points: DataFrame, span: int = SPAN) -> DataFrame:
    """``seq, ts_ms, clock`` of distinct points: ``clock`` is the largest ``ts_ms`` up to the point."""
    p = points.select("seq", "ts_ms").distinct().withColumn("_range", ranged("seq", span))
    start = carried(p.groupBy("_range").agg(F.max("ts_ms").alias("_end")), "max")
    top = F.max("ts_ms").over(Window.partitionBy("_range").orderBy("seq").rowsBetween(*_SO_FAR))
    return p.join(start, "_range").select("seq", "ts_ms", F.greatest(top, "_start").alias("clock"))


def first_reached(times: DataFrame, clocks: DataFrame, width: int, few: bool = False) -> DataFrame:
    """``t, at`` of each distinct time ``t``: the first ``seq`` whose ``clock`` is not below it; null if none is. ``few``: see carried."""
    marks = clocks.groupBy("clock").agg(F.min("seq").alias("at")).select((-F.col("clock")).alias("x"), "at", F.lit(0).alias("ask"))
    rows = marks.unionByName(times.select((-F.col("t")).alias("x"), F.lit(None).cast("bigint").alias("at"), F.lit(1).alias("ask"))).withColumn("_range", ranged("x", width))
    start = carried(rows.groupBy("_range").agg(F.max_by("at", F.when(F.col("ask") == 0, F.col("x"))).alias("_end")), "last", few=few)
    near = F.last("at", ignorenulls=True).over(Window.partitionBy("_range").orderBy("x", "ask").rowsBetween(*_SO_FAR))
    found = rows.join(start, "_range").withColumn("at", F.coalesce(near, "_start"))
    return found.filter("ask = 1").select((-F.col("x")).alias("t"), "at")


def dbsize_at(versions: DataFrame, points: DataFrame, span: int = SPAN) -> DataFrame:
    """``seq, dbsize`` of points ``seq, ts_ms``: how many keys are live at each.

    A version counts from its begin to its end or to the first point whose running clock has reached its expiry. So
    its life is +1 and -1 at two sequence numbers, and a point's size is the sum before it: ranges of ``span``
    sequence numbers are summed apart, with one carried row each. A point whose own clock is behind the running one
    gets back what has expired between the two: those versions are joined on slots of time.
    """
    seen = Observation()
    clocks = clocked(points, span).observe(seen, *[F.min("ts_ms").alias("low"), F.max("clock").alias("high"), F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.max(F.expr("ts_ms < clock")).alias("behind")])
    clocks = stored(clocks, "clocks")
    low, high, n, last, late = (seen.get[k] for k in ("low", "high", "n", "last", "behind"))
    if not n:
        return clocks.select("seq", F.lit(0).cast("bigint").alias("dbsize"))
    width = (high - low) // (n // span + 1) + 1
    alive = versions.filter("op <> 'DEL'").select("seq_from", "seq_to", "expires_at_ms")
    reached = F.when(F.col("expires_at_ms") <= low, F.lit(low)).otherwise(F.col("expires_at_ms"))  # the first point has reached all before it: times lie in as many ranges as clocks
    times = alive.filter(F.col("expires_at_ms") <= high).select(reached.alias("t")).distinct()
    ended = alive.join(first_reached(times, clocks, width, n // span < FEW), reached == F.col("t"), "left")
    ended = ended.select("seq_from", F.least("seq_to", F.coalesce(F.col("at") - 1, F.lit(NEVER))).alias("end")).filter("end > seq_from")
    steps = ended.select(F.explode(F.array(F.struct(F.col("seq_from").alias("seq"), F.lit(1).alias("w")), F.struct(F.col("end").alias("seq"), F.lit(-1).alias("w")))).alias("e")).select("e.*")
    steps = steps.filter(F.col("seq") < last).groupBy("seq").agg(F.sum("w").alias("w"))  # what begins or ends at one place is one row
    rows = steps.select("seq", "w", F.lit(None).cast("bigint").alias("ts_ms")).unionByName(clocks.select("seq", F.lit(0).cast("bigint").alias("w"), "ts_ms")).withColumn("_range", ranged("seq", span))
    span_of = Observation()
    rows = stored(rows.observe(span_of, F.min("_range").alias("first"), F.max("_range").alias("last")), "steps")  # read by the ranges' sums and by the points'
    start = carried(rows.groupBy("_range").agg(F.sum("w").alias("_end")), "sum", few=span_of.get["last"] - span_of.get["first"] < FEW)
    # a step counts for the points after its place: at one place, points come first
    order = Window.partitionBy("_range").orderBy("seq", F.col("ts_ms").asc_nulls_last()).rowsBetween(*_SO_FAR)
    sized = rows.join(start, "_range").withColumn("n", F.sum("w").over(order) + F.col("_start")).filter("ts_ms IS NOT NULL").select("seq", "ts_ms", "n")
    if not late:  # no point's clock is behind
        return sized.select("seq", F.col("n").cast("bigint").alias("dbsize"))
    behind = clocks.filter("ts_ms < clock").withColumn("slot", F.explode(F.sequence(ranged("ts_ms", width), ranged("clock", width)))).alias("p")
    v = alive.filter(F.col("expires_at_ms").between(low, high)).withColumn("slot", ranged("expires_at_ms", width)).alias("v")
    hit = F.expr("p.slot = v.slot AND v.seq_from < p.seq AND p.seq <= v.seq_to AND v.expires_at_ms > p.ts_ms AND v.expires_at_ms <= p.clock")
    back = behind.join(v, hit).groupBy("p.seq", "p.ts_ms").agg(F.count(F.lit(1)).alias("more"))
    return sized.join(back, ["seq", "ts_ms"], "left").select("seq", (F.col("n") + F.coalesce("more", F.lit(0))).cast("bigint").alias("dbsize"))


def key_ranges(rows: DataFrame) -> Callable[[Column], Column]:
    """The number of the key range that a key falls in, RANGES at most, of about equal numbers of keys.

    The boundaries come from a sample of distinct keys (of each of some hash values the least), taken in one pass;
    they only tell which task sorts a key. A key finds its range among the boundaries in two steps.
    """
    sample = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(RANGES * SAMPLED)).alias("h")).agg(F.min("key").alias("key")).select("key")
    keys = sorted((r["key"] for r in sample.collect()), key=str.encode)  # RANGES * SAMPLED rows at most
    parts = min(RANGES, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = keys[:: max(1, len(keys) // parts)][1:]
    if not cuts:
        return lambda key: F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    rough = F.array(*[F.lit(c) for c in cuts[::step]])
    fine = F.array(F.array().cast("array<string>"), *[F.array(*[F.lit(c) for c in cuts[i + 1 : i + step]]).cast("array<string>") for i in range(0, len(cuts), step)])

    def number(key: Column) -> Column:
        above = F.size(F.filter(rough, lambda e: e <= key))
        return above * step + F.size(F.filter(F.element_at(fine, above + 1), lambda e: e <= key))

    return number


def scan_many(view: DataFrame, requests: DataFrame) -> DataFrame:
    """What many range scans ``lo, hi`` read of one view ``key, ...`` of distinct keys: the requests' other columns and the view's.

    Keys are numbered in order (ranges of them are sorted apart, with carried counts), and the bounds of the scans
    take part in the same sort, so each scan becomes the numbers it covers, which join by equality. The work grows with
    the keys, the scans and the rows returned, never with their product.
    """
    view, wanted = stored(view, "scanned"), requests.filter("lo < hi")
    bounds = wanted.select(F.explode(F.array("lo", "hi")).alias("key")).distinct()
    number = key_ranges(view)
    rows = view.withColumn("_own", F.lit(1)).unionByName(bounds.withColumn("_own", F.lit(0)), allowMissingColumns=True).withColumn("_range", number(F.col("key")))
    start = carried(rows.groupBy("_range").agg(F.sum("_own").alias("_end")), "sum")
    # keys below: a bound stands before an equal key
    order = Window.partitionBy("_range").orderBy("key", "_own").rowsBetween(*_SO_FAR)
    placed = rows.join(start, "_range").withColumn("_below", F.sum("_own").over(order) + F.col("_start"))
    at = placed.filter("_own = 0").select("key", "_below")
    spans = wanted.join(at.select(F.col("key").alias("lo"), F.col("_below").alias("_a")), "lo").join(at.select(F.col("key").alias("hi"), F.col("_below").alias("_b")), "hi").filter("_a < _b")
    blocks = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_a") / BLOCK), F.floor((F.col("_b") - 1) / BLOCK))))
    each = blocks.withColumn("_n", F.explode(F.sequence(F.greatest("_a", F.col("_block") * BLOCK), F.least("_b", (F.col("_block") + 1) * BLOCK) - 1)))
    keys = placed.filter("_own = 1").select((F.col("_below") - 1).alias("_n"), *view.columns)
    return each.drop("lo", "hi", "_a", "_b", "_block").join(keys, "_n").drop("_n")


def scan_at(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """``seq, key, value`` of what scans ``seq, ts_ms, lo, hi`` read, each as of its place in the log.

    Each scan is resolved to the keys it covers, which are then read as of its place (see resolve.as_of): a key's
    versions and its readers meet in one sort.
    """
    versions = stored(versions, "versions")
    asked = scan_many(versions.select("key").distinct(), requests.select("seq", "ts_ms", "lo", "hi"))
    read = as_of(versions, asked.select(F.col("seq").alias("request_id"), "key", (F.col("seq") - 1).alias("at_seq"), F.col("ts_ms").alias("now_ms")))
    return read.filter("value IS NOT NULL").select(F.col("request_id").alias("seq"), "key", "value")
