import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_of
from millrace.operators import alarms, cdc, metrics, timeline

T0 = dt.datetime(2024, 1, 1)


def stamped(spark, offsets_us):
    data = [(i, T0 + dt.timedelta(microseconds=o)) for i, o in enumerate(offsets_us)]
    return spark.createDataFrame(data, "id int, ts timestamp_ntz")


def test_sliding_count_edges(spark, rows):
    minute = 60_000_000
    # Exactly one minute apart counts, one microsecond more does not; equal instants see each other.
    df = stamped(spark, [0, minute, 2 * minute + 1, 2 * minute + 1])
    assert rows(timeline.sliding_count(df).select("id", "record_count")) == [(0, 1), (1, 2), (2, 2), (3, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_count_equals_one_task_window(spark, seed):
    rnd = random.Random(seed)
    offsets = [rnd.choice([0, 1, 999_999, 1_000_000]) + rnd.randrange(0, 200) * rnd.choice([1, 500_000, 1_000_000]) for _ in range(500)]
    df = stamped(spark, offsets)
    fast = timeline.sliding_count(df).select("id", "record_count")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    whole = Window.orderBy(us).rangeBetween(-60_000_000, 0)
    slow = df.select("id", F.count(F.lit(1)).over(whole).cast("int").alias("record_count"))
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0


def test_sliding_count_is_never_one_task(spark):
    assert "SinglePartition" not in plan_of(timeline.sliding_count(stamped(spark, [0, 1])))


def test_carry_forward_equals_one_window(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([1, 1, None, None, 2, 3]), rnd.randrange(50), i, rnd.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(data, "k int, t int, id int, v int")
    for current in (True, False):
        got = timeline.carry_forward(df, ["k"], ["t", "id"], F.col("v"), "seen", current)
        w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        want = df.withColumn("seen", F.last("v", ignorenulls=True).over(w))
        assert got.select(*want.columns).exceptAll(want).count() == 0
        assert got.count() == 400


def test_carry_forward_cuts_a_hot_key(spark):
    # One key holds nine tenths of the rows; its only value comes first.
    df = spark.range(1000).select(
        F.when(F.col("id") % 10 == 9, F.col("id")).otherwise(F.lit(1)).alias("k"), F.col("id").alias("t"),
        F.when(F.col("id") == 0, F.lit(7)).alias("v")).repartition(4)
    got = timeline.carry_forward(df, ["k"], ["t"], F.col("v"), "seen")
    assert got.where("seen = 7").count() == 900 and got.where("k <> 1 and seen is not null").count() == 0
    assert "rangepartitioning" in plan_of(df.repartitionByRange("k", "t"))


def test_a_null_key_follows_nothing(spark, rows):
    s = dt.timedelta(seconds=1)
    alerts = spark.createDataFrame([(None, T0, 1), (5, T0, 2)], "u int, ts timestamp_ntz, id int")
    acks = spark.createDataFrame([(None, T0 + s, 3), (5, T0 + s, 4)], "u int, ts timestamp_ntz, id int")
    assert rows(timeline.alert_escalation(alerts, acks, "u", "ts", "id").select("id", "status")) == [(1, "ESCALATED"), (2, "RESOLVED")]
    feats = acks.select("u", (F.col("ts") - F.expr("interval 5 seconds")).alias("ft"), F.lit(1.5).alias("f"), "id")
    found = timeline.point_in_time(alerts, feats, "u", "ts", "ft", ["f"], "id")
    assert rows(found.select("id", "f")) == [(1, None), (2, 1.5)]


def test_change_feed_views(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, seq int, v string")
    assert rows(timeline.change_feed_images(df, ["k"], "seq", ["v"])) == [(1, 1, "a", None), (1, 2, "b", "a"), (2, 1, "c", None)]
    assert rows(timeline.change_feed_images(df, ["k"], "seq", ["v"], "OLD_IMAGE")) == [(1, 1, None), (1, 2, "a"), (2, 1, None)]
    assert timeline.change_feed_images(df, ["k"], "seq", ["v"], "KEYS_ONLY").columns == ["k", "seq"]
    assert timeline.change_feed_images(df, ["k"], "seq", ["v"], "NEW_IMAGE").columns == ["k", "seq", "new_v"]
    with pytest.raises(ValueError):
        timeline.change_feed_images(df, ["k"], "seq", ["v"], "ALL")


def test_point_in_time_takes_equal_times(spark, rows):
    labels = spark.createDataFrame([(1, T0, 10), (1, T0 - dt.timedelta(days=1), 11)], "k int, at timestamp_ntz, id int")
    feats = spark.createDataFrame([(1, T0, 5.0, 1), (1, T0 + dt.timedelta(days=1), 6.0, 2)], "k int, ft timestamp_ntz, f double, id int")
    found = timeline.point_in_time(labels, feats, "k", "at", "ft", ["f"], "id")
    assert rows(found.select("id", "f")) == [(10, 5.0), (11, None)]


def test_alert_escalation_deadline_is_inclusive(spark, rows):
    s = dt.timedelta(seconds=1)
    alerts = spark.createDataFrame([(1, T0, 1), (2, T0, 2), (3, T0, 3)], "u int, ts timestamp_ntz, id int")
    acks = spark.createDataFrame([(1, T0 + 300 * s, 4), (2, T0 + 301 * s, 5), (3, T0 - s, 6)], "u int, ts timestamp_ntz, id int")
    out = timeline.alert_escalation(alerts, acks, "u", "ts", "id")
    assert rows(out.select("u", "status")) == [(1, "RESOLVED"), (2, "ESCALATED"), (3, "ESCALATED")]


def test_alarm_gap(spark):
    p = [T0 + dt.timedelta(minutes=5 * i) for i in range(4)]
    two = spark.createDataFrame([("s", p[0], 5), ("s", p[1], 5)], "k string, period timestamp_ntz, v int")
    assert [r.state for r in alarms.evaluate(two, ["k"], "v", 1).orderBy("period").collect()] == ["OK", "ALARM"]
    gap = spark.createDataFrame([("s", p[0], 5), ("s", p[2], 5)], "k string, period timestamp_ntz, v int")
    states = lambda m: [r.state for r in alarms.evaluate(gap, ["k"], "v", 1, missing=m).orderBy("period").collect()]
    assert states(alarms.NOT_BREACHING) == ["OK", "OK", "OK"]
    assert states(alarms.BREACHING) == ["OK", "ALARM", "ALARM"]


def test_alarm_outside_band(spark):
    df = spark.createDataFrame([("s", T0, 5)], "k string, period timestamp_ntz, v int")
    state = lambda band: alarms.evaluate(df, ["k"], "v", band, alarms.OUTSIDE_BAND, 1).first().state
    assert (state((0, 4)), state((0, 6))) == ("ALARM", "OK")


def test_composite_rule(spark, rows):
    df = spark.createDataFrame([(1, "a", "ALARM"), (1, "b", "OK"), (2, "a", "OK")], "period int, alarm string, state string")
    assert rows(alarms.composite(df, "alarm", "ALARM('a') AND NOT ALARM(b)").select("period", "composite")) == [(1, "ALARM"), (2, "OK")]


def test_cost_per_record_zero_guard(spark, rows):
    df = spark.createDataFrame([("a", 5.0, 0), ("b", 6.0, 3)], "p string, cost double, n int")
    assert rows(metrics.cost_per_record(df, "p", "cost", F.col("n")).select("p", "cost_per_record")) == [("a", 0.0), ("b", 2.0)]


def test_cdc_apply_cases(spark, rows):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    changes = spark.createDataFrame([
        (1, "D", 3, None), (1, "U", 2, "late"), (3, "I", 1, "n"), (3, "U", 2, "m"), (9, "D", 1, None), (2, "U", 1, None)],
        "k int, op string, seq long, v string")
    assert rows(cdc.apply_changes(base, changes, ["k"])) == [(2, None), (3, "m")]


def test_reconcile_null_safe(spark, rows):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "z")], "k int, v string")
    assert rows(cdc.reconcile(a, b, ["k"], ["v"])) == [
        (1, "MATCH", None), (2, "MISMATCH", "v"), (3, "MISSING_IN_TARGET", None), (4, "EXTRA_IN_TARGET", None)]
