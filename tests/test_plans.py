"""The plans that the design counts on."""

from pyspark.sql import functions as F

from keelstone.operators import counters, lookup, maintain, pubsub, resolve
from keelstone.schema import MUTATIONS, NEVER


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored_log(spark, path):
    rows = [(i, 0, "PUT", f"k{i % 50:03d}", str(i), NEVER) for i in range(500)]
    return maintain.compact(spark.createDataFrame(rows, MUTATIONS), path, partitions=4)


def test_key_filters_reach_the_scan(spark, tmp_path):
    log = stored_log(spark, str(tmp_path / "log"))
    point = plan_of(lookup.get(resolve.live(log, 0), "k007"))
    assert "EqualTo(key,k007)" in point and "ts_ms" not in point.split("ReadSchema")[-1]
    span = plan_of(lookup.scan(resolve.live(log, 0), "k001", "k010"))
    assert "GreaterThanOrEqual(key,k001)" in span and "LessThan(key,k010)" in span


def test_latest_per_key_drops_rows_before_the_shuffle(spark, tmp_path):
    plan = plan_of(resolve.live(stored_log(spark, str(tmp_path / "log")), 0))
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1 and "Python" not in plan


def test_counter_totals_combine_first(spark, tmp_path):
    log = stored_log(spark, str(tmp_path / "log")).select("key", F.lit(1).cast("bigint").alias("delta"))
    assert "partial_sum" in plan_of(counters.totals(log))


def test_top_keys_is_a_top_k(spark, tmp_path):
    assert "TakeOrderedAndProject" in plan_of(lookup.top_keys(resolve.live(stored_log(spark, str(tmp_path / "log")), 0), 3))


def test_channels_meet_by_equality(spark):
    msgs = spark.createDataFrame([(1, 3, "news", "x")], "msg_id bigint, seq bigint, channel string, payload string")
    subs = spark.createDataFrame([("a", "channel", "news", 0, NEVER)], "conn string, kind string, target string, seq_from bigint, seq_to bigint")
    plan = plan_of(pubsub.matches(msgs, subs).filter("kind = 'channel'"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_compacted_runs_do_not_overlap(spark, tmp_path):
    log = stored_log(spark, str(tmp_path / "log"))
    runs = log.groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect()
    assert len(runs) > 1 and all(a["hi"] < b["lo"] for a, b in zip(runs, runs[1:], strict=False))
