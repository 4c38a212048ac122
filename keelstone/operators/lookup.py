"""Reads by key and key range over a live view or a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ttl_ms, ttl_seconds
from .resolve import latest_per_key, live, not_expired


def get(view: DataFrame, key: str) -> DataFrame:
    """The live value of one key; the equality reaches the scan through the view's window."""
    return view.filter(F.col("key") == key).select("key", "value")


def mget(view: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, values`` for ``request_id, keys``: in the order asked, repeats and absent keys (null) included."""
    asked = requests.select("request_id", F.posexplode("keys").alias("pos", "key"))
    found = asked.join(view.select("key", "value"), "key", "left")
    rows = F.array_sort(F.collect_list(F.struct("pos", "value")))  # a struct, as null items would be left out
    return found.groupBy("request_id").agg(F.transform(rows, lambda r: r["value"]).alias("values"))


def exists_count(view: DataFrame, requests: DataFrame) -> DataFrame:
    """How many of the keys asked for are live, a repeated key counted each time."""
    asked = requests.select("request_id", F.explode("keys").alias("key"))
    hits = asked.join(view.select("key", F.lit(1).alias("hit")), "key", "left")
    return hits.groupBy("request_id").agg(F.count("hit").alias("n_exists"))


def del_count(view: DataFrame, requests: DataFrame) -> DataFrame:
    """How many keys a delete would remove: a repeated key is gone the second time."""
    asked = requests.select("request_id", F.explode("keys").alias("key")).dropDuplicates(["request_id", "key"])
    hits = asked.join(view.select("key", F.lit(1).alias("hit")), "key", "left")
    return hits.groupBy("request_id").agg(F.count("hit").alias("n_deleted"))


def scan(view: DataFrame, start: str, end: str) -> DataFrame:
    """Live entries with ``start <= key < end`` in key order (of UTF-8 bytes)."""
    if start > end:
        raise ValueError("the range's start is after its end")
    return view.filter((F.col("key") >= start) & (F.col("key") < end)).select("key", "value").orderBy("key")


def scan_flat(view: DataFrame, start: str, end: str) -> DataFrame:
    """A scan as alternating keys and values: ``key, part (0 or 1), item``."""
    rows = scan(view, start, end)
    return rows.select("key", F.posexplode(F.array("key", "value")).alias("part", "item"))


def top_keys(view: DataFrame, n: int, descending: bool = False) -> DataFrame:
    """The first (or last) n live keys; a top-k of each task before one merge."""
    key = F.col("key").desc() if descending else F.col("key").asc()
    return view.select("key", "value").orderBy(key).limit(n)


def ttl(mutations: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """``key, ttl_ms, ttl_sec`` of each distinct key asked for."""
    asked = keys.select("key").distinct()
    found = asked.join(live(mutations, now_ms).select("key", "expires_at_ms", F.lit(True).alias("hit")), "key", "left")
    ms = ttl_ms(F.coalesce("hit", F.lit(False)), F.col("expires_at_ms"), now_ms)
    return found.select("key", ms.alias("ttl_ms"), ttl_seconds(ms).alias("ttl_sec"))


def persistable(mutations: DataFrame, now_ms: int) -> DataFrame:
    """For each key ever written, 1 if removing its expiry would change it: live and with one."""
    from ..schema import DEL, NEVER

    newest = latest_per_key(mutations)
    return newest.select("key", F.when((F.col("op") != DEL) & not_expired(now_ms) & (F.col("expires_at_ms") != NEVER), 1).otherwise(0).alias("persisted"))


def dbsize(view: DataFrame) -> DataFrame:
    return view.agg(F.count(F.lit(1)).alias("dbsize"))
