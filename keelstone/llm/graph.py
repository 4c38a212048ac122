"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks among which the rows of one key are dealt when they meet the key's one row.
SALTS = 1024


def dealt_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` (with a ``salt`` below SALTS) joined with the one row that ``facts`` has for their ``key``; no salt after.

    First each key's salts meet its fact (at most SALTS rows of a key), then rows meet facts by key and salt,
    so no task gets all rows of a hot key. Rows whose key has no fact go.
    """
    asked = rows.select(key, "salt").distinct().join(facts, key)
    return rows.join(asked, [key, "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a bigint, b bigint)``; root is the component's smallest node.

    Each round replaces links by links to the smallest neighbour, so paths halve in length. The smallest
    neighbour is an aggregate (combined before the shuffle), joined back on the node with one row for each
    key, so a hub's links can be split among tasks. Rounds are cut by ``checkpoint()``.
    """
    both = links.filter("a <> b")
    edges = both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        if not seen and edges.isEmpty():
            break
        # large star: larger neighbours of u go to u's smallest neighbour
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = small.filter("u <> v").distinct().checkpoint()
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
