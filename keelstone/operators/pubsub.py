"""Publish and subscribe: routing of messages to connections by channel and by glob."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import resp
from ..functions.text import glob_regex
from ..schema import NEVER


#: Characters at most of a run between wildcards that channels are looked up by.
GRAM = 32


def intervals(changes: DataFrame) -> DataFrame:
    """Subscription intervals of changes ``conn, kind, target, seq, pos, add``: from a first add to the next removal."""
    order = Window.partitionBy("conn", "kind", "target").orderBy("seq", "pos")
    # only a change of state opens or closes an interval
    real = changes.withColumn("_was", F.coalesce(F.lag("add").over(order), F.lit(False))).filter(F.col("add") != F.col("_was"))
    ended = real.withColumn("seq_to", F.lead("seq", 1, NEVER).over(order))
    return ended.filter("add").select("conn", "kind", "target", F.col("seq").alias("seq_from"), "seq_to")


def _now(m: str, s: str) -> F.Column:
    return (F.col(f"{s}.seq_from") < F.col(f"{m}.seq")) & (F.col(f"{m}.seq") < F.col(f"{s}.seq_to"))


def met(channels: DataFrame, globs: DataFrame) -> DataFrame:
    """``target, channel`` of distinct ``channel`` and distinct ``target``: every glob that matches a channel.

    A glob fixes characters: at their places before its first wildcard, from the end after its last, or a run
    between two. Globs of one shape (the places that they fix) meet the channels by what stands there, in an equality
    join, and the regular expression decides; so the work grows with the channels times the shapes, not times the globs.
    """
    n = F.length("head")
    places = lambda text, first: F.filter(F.when(F.length(text) > 0, F.sequence(first, first + F.length(text) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, 1) != "?")
    # brackets and braces pass through to the expression: what is fixed ends before them, and a brace takes a character along
    parts = globs.select(
        "target", F.regexp_extract("target", r"\A([^*\[\]{}]*)", 1).alias("head"), F.regexp_extract("target", r"([^*\[\]{}]*)\z", 1).alias("tail"),
        F.when(~F.col("target").rlike(r"[\[\]{}]"), F.array_max(F.transform(F.split("target", r"[*?]"), lambda x: F.struct(F.length(x).alias("n"), F.left(x, F.lit(GRAM)).alias("run"))))["run"]).alias("run"),
    )
    whole = F.col("head") == F.col("target")
    brace = F.substring("target", n + 1, 1) == "{"
    parts = parts.withColumns({"whole": whole, "tail": F.when(whole, F.lit("")).otherwise(F.col("tail")), "head": F.when(brace, F.expr("left(head, length(head) - 1)")).otherwise(F.col("head"))})
    anchored = F.concat(F.regexp_replace("head", "[?]", ""), F.regexp_replace("tail", "[?]", ""))
    size, b = F.length("head") + F.length("tail"), F.length("tail")
    at = F.concat(places(F.col("head"), F.lit(1)), F.transform(places(F.col("tail"), F.lit(1)), lambda i: i - b - 1))
    inside = F.coalesce(F.length("run") > F.length(anchored), F.lit(False))  # a run between wildcards tells globs apart better
    keyed = parts.select(
        "target", F.when(inside, F.col("run")).otherwise(anchored).alias("key"), F.when(inside, F.length("run")).otherwise(F.lit(0)).alias("gram"),
        F.when(~inside, at).alias("at"), size.alias("least"), F.when(F.col("whole"), size).alias("most"),
    ).withColumn("shape", F.to_json(F.struct("gram", "at", "least", "most")))
    fits = (F.length("channel") >= F.col("least")) & (F.length("channel") <= F.coalesce("most", F.length("channel"))) & (F.length("channel") >= F.col("gram"))
    asked = channels.join(F.broadcast(keyed.select("shape", "gram", "at", "least", "most").distinct()), fits)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("channel") - F.col("gram") + 1), lambda i: F.substring(F.col("channel"), i, F.col("gram"))))
    fixed = F.array(F.array_join(F.transform("at", lambda i: F.substring(F.col("channel"), i, F.lit(1))), ""))
    asked = asked.select("channel", "shape", F.explode(F.when(F.col("gram") > 0, runs).otherwise(fixed)).alias("key"))
    near = asked.join(keyed.select("target", "shape", "key", glob_regex(F.col("target")).alias("regex")), ["shape", "key"])
    return near.filter(F.expr("rlike(channel, regex)")).select("target", "channel")


def matches(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """Every subscription that a message meets: ``msg_id, conn, kind, target``.

    Channels meet by equality. Globs are matched with the distinct channels (see met), and a pattern without wildcards is
    an equality too. Subscriptions are then dealt to the channels they hear, so messages are
    shuffled once, by channel: a pattern that hears all of them draws them into no one task.
    """
    columns = ["conn", "kind", "target", "seq_from", "seq_to"]
    patterns = subs.filter("kind = 'pattern'").select("target").distinct()
    wild = F.col("target").rlike(r"[*?\[\]{}]")
    plain = patterns.filter(~wild).select("target", F.col("target").alias("channel"))
    heard = met(messages.select("channel").distinct(), patterns.filter(wild)).unionByName(plain)
    routes = subs.filter("kind = 'channel'").select(F.col("target").alias("channel"), *columns).unionByName(heard.join(subs.filter("kind = 'pattern'"), "target").select("channel", *columns))
    both = messages.alias("m").join(routes.alias("s"), (F.col("m.channel") == F.col("s.channel")) & _now("m", "s"))
    return both.select(F.col("m.msg_id").alias("msg_id"), F.col("s.conn").alias("conn"), F.col("s.kind").alias("kind"), F.col("s.target").alias("target"))


def _dealt(rows: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """Rows in as many parts as shuffles have, or in ``parts``: adaptive execution would join parts that compress well into few large sorts."""
    return rows.repartition(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def deliveries(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """One delivery for each message and connection: its channel if it has subscribed to that, else its least pattern."""
    best = _dealt(matches(messages, subs), "msg_id", "conn").groupBy("msg_id", "conn").agg(F.min(F.struct("kind", "target")).alias("_b"))  # 'channel' < 'pattern'
    return best.select("msg_id", "conn", F.col("_b.kind").alias("kind"), F.col("_b.target").alias("target"))


def frames(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """``msg_id, conn, frame``: the bytes that each receiver gets."""
    out = deliveries(messages, subs).join(_dealt(messages.select("msg_id", "channel", "payload"), "msg_id"), "msg_id")
    direct = resp.array(F.array(F.lit("message"), "channel", "payload"))
    by_glob = resp.array(F.array(F.lit("pmessage"), "target", "channel", "payload"))
    return out.select("msg_id", "conn", F.when(F.col("kind") == "channel", direct).otherwise(by_glob).alias("frame"))


def publish_counts(messages: DataFrame, subs: DataFrame, parts: int | None = None) -> DataFrame:
    """``msg_id, receivers`` of every message, 0 included. ``parts``: see _dealt, for messages whose number the caller knows to be small."""
    # a receiver counts once, whatever it has heard by: hashing is enough, where the choice of a delivery sorts
    heard = _dealt(matches(messages, subs).select("msg_id", "conn"), "msg_id", "conn", parts=parts).distinct()
    each = messages.select("msg_id", F.lit(0).cast("bigint").alias("n")).unionByName(heard.select("msg_id", F.lit(1).cast("bigint").alias("n")))
    return _dealt(each, "msg_id", parts=parts).groupBy("msg_id").agg(F.sum("n").alias("receivers"))
