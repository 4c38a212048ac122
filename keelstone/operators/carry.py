"""What ranges of an ordered table hand on to the ranges after them, for running sums and maxima that no one task sees whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Ranges that are summed up by one row of the level above, and ranges that need no such level.
WIDE, FEW = 1000, 50_000


def carried(ends: DataFrame, how: str, wide: int = WIDE, few: bool = False) -> DataFrame:
    """``_range, _start``: of each row ``_range, _end``, what the rows of lower ranges add up to.

    ``how``: 'sum' (0 before the first), 'max', or 'last' (the nearest that is not null); null if there is none.
    Two levels: ranges within a group of ``wide``, then groups. Only the groups meet in one window, one row for each; where the
    caller knows that ranges are ``few``, they meet there themselves.
    """
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("_end")
    whole, running, both = {
        "sum": (F.sum(end), F.sum(end), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "max": (F.max(end), F.max(end), F.greatest),
        "last": (F.max_by(end, F.when(end.isNotNull(), F.col("_range"))), F.last(end, ignorenulls=True), F.coalesce),
    }[how]
    if few:
        before = running.over(earlier)
        return ends.select("_range", (F.coalesce(before, F.lit(0)) if how == "sum" else before).alias("_start"))
    grouped = ends.select("_range", "_end", F.floor(F.col("_range") / wide).alias("_group"))
    tops = grouped.groupBy("_group").agg(whole.alias("_end")).withColumnRenamed("_group", "_range")
    tops = tops.select(F.col("_range").alias("_group"), running.over(earlier).alias("_top"))
    inner = running.over(earlier.partitionBy("_group"))
    return grouped.join(tops, "_group").select("_range", both(inner, F.col("_top")).alias("_start"))


def ranged(column: str, span: int) -> Column:
    """The number of the range of ``span`` values that a value falls in."""
    return F.floor(F.col(column) / span)


def sums_at(points: DataFrame, events: DataFrame, columns: list[str], span: int) -> DataFrame:
    """``points`` (distinct ``seq``) with the sums of ``columns`` over the ``events`` whose ``seq`` is not above theirs."""
    rows = events.groupBy("seq").agg(*[F.sum(c).alias(c) for c in columns]).withColumn("_ask", F.lit(False))
    rows = rows.unionByName(points.select("seq", *[F.lit(0).cast("bigint").alias(c) for c in columns], F.lit(True).alias("_ask"))).withColumn("_range", ranged("seq", span))
    rows = stored(rows, "sums")  # read once for each column and once more
    so_far = Window.partitionBy("_range").orderBy("seq", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows
    for c in columns:
        start = carried(rows.groupBy("_range").agg(F.sum(c).alias("_end")), "sum").withColumnRenamed("_start", f"_{c}")
        out = out.join(start, "_range").withColumn(f"_all_{c}", F.sum(c).over(so_far) + F.col(f"_{c}"))
    return out.filter("_ask").select("seq", *[F.col(f"_all_{c}").cast("bigint").alias(c) for c in columns])
