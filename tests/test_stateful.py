"""Streams on Spark's own state: equal to the batch operators, and the state shrinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import alarms, timeline
from millrace.streaming import jobs, stateful

T0 = dt.datetime(2024, 1, 1)


class Feed:
    """Drops of rows run through one stream."""

    def __init__(self, spark, root, schema, writer):
        self.spark, self.root, self.schema, self.writer = spark, str(root), schema, writer

    def send(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        stream = jobs.file_stream(self.spark, f"{self.root}/in", self.schema, "parquet")
        sink = self.writer(stream).writeStream.format("parquet").option("path", f"{self.root}/out")
        return jobs.run_available(sink, f"{self.root}/checkpoint")

    def out(self):
        return self.spark.read.parquet(f"{self.root}/out").collect()


def held(query):
    return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])


ALERTS = "user_id int, event_id long, ts timestamp_ntz, kind string"


def escalation(stream):
    return stateful.escalate(
        stream, "user_id", "event_id", "ts", F.col("kind") == "error", F.col("kind") == "click", "300 seconds", "60 seconds")


def at(user, event, second, kind):
    return (user, event, T0 + dt.timedelta(seconds=second), kind)


def test_escalation_waits_for_the_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path, ALERTS, escalation)
    feed.send([at(1, 1, 0, "error"), at(2, 2, 0, "error"), at(None, 7, 5, "error"), (3, 8, None, "error"), at(None, 9, 6, "click")])
    feed.send([at(1, 3, 200, "click"), at(1, 4, 210, "click"), at(2, 5, 301, "click")])
    assert {(r.event_id, r.status) for r in feed.out()} == {(1, "RESOLVED"), (8, "ESCALATED")}
    before = feed.send([at(9, 6, 400, "other")])
    after = feed.send([at(9, 10, 90_000, "other")])
    got = [(r.event_id, r.status) for r in feed.out()]
    assert sorted(got) == [(1, "RESOLVED"), (2, "ESCALATED"), (7, "ESCALATED"), (8, "ESCALATED")]
    assert held(after) < held(before)


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_escalation_equals_the_batch_form(spark, tmp_path, order):
    """Two orders of arrival within the allowed delay; a user with most of the rows."""
    import random

    rng = random.Random(6)
    rows = [
        at(1 if rng.random() < 0.6 else rng.randint(2, 30), i, rng.randint(0, 3000), rng.choice(["error", "click", "view"]))
        for i in range(900)
    ]
    feed = Feed(spark, tmp_path, ALERTS, lambda stream: stateful.escalate(
        stream, "user_id", "event_id", "ts", F.col("kind") == "error", F.col("kind") == "click", "30 seconds", "2 hours"))
    for part in order:
        feed.send([r for r in rows if r[1] % 3 == part])
    feed.send([at(99, -1, 900_000, "view")])
    frame = spark.createDataFrame(rows, ALERTS)
    want = timeline.alert_escalation(
        frame.where("kind = 'error'"), frame.where("kind = 'click'"), "user_id", "ts", "event_id", (30,))
    assert sorted((r.event_id, r.status) for r in feed.out()) == sorted((r.event_id, r.status) for r in want.collect())


@pytest.mark.parametrize("slices", [1, 4])
def test_sliding_count_equals_the_batch_form(spark, tmp_path, slices):
    import random

    rng = random.Random(slices)
    schema = "id long, ts timestamp_ntz"
    rows = [(i, T0 + dt.timedelta(milliseconds=rng.choice([rng.randint(0, 600_000), 60_000, 120_000, 120_001]))) for i in range(700)]
    feed = Feed(spark, tmp_path, schema, lambda stream: stateful.sliding_count(stream, slices=slices, delay="20 minutes"))
    for part in range(3):
        feed.send([r for r in rows if r[0] % 3 == part])
    feed.send([(1000, None)])
    last = feed.send([(-1, T0 + dt.timedelta(days=1))])
    want = {r.id: r.record_count for r in timeline.sliding_count(spark.createDataFrame(rows, schema)).collect()}
    assert {r.id: r.record_count for r in feed.out()} == want | {1000: None}
    assert len(feed.out()) == len(rows) + 1
    # All that is left is the slice of the last row.
    assert held(last) <= 3


def test_late_rows_are_counted_as_dropped(spark, tmp_path):
    schema = "id long, ts timestamp_ntz"
    feed = Feed(spark, tmp_path, schema, lambda stream: stateful.sliding_count(stream))
    minute = lambda i, m: (i, T0 + dt.timedelta(minutes=m))
    feed.send([minute(1, 1), minute(2, 2), minute(10, 10)])
    late = feed.send([minute(3, 3), minute(11, 11)])
    feed.send([minute(99, 999)])
    assert {r.id: r.record_count for r in feed.out()} == {1: 1, 2: 2, 10: 1, 11: 2}
    assert sum(s["numRowsDroppedByWatermark"] for p in late.recentProgress for s in p["stateOperators"]) == 1


def test_ttl_renewals_and_expiry(spark, tmp_path):
    schema = "k string, ts timestamp_ntz"
    feed = Feed(spark, tmp_path, schema, lambda stream: stateful.expired(stream, ["k"], "ts", "10 minutes", "0 seconds"))
    minute = lambda k, m: (k, None if m is None else T0 + dt.timedelta(minutes=m))
    first = feed.send([minute("a", 0), minute("b", 0), minute("c", 1), minute(None, 1), minute("d", None)])
    feed.send([minute("a", 9), minute("x", 12)])
    live = {r.k: r.expires_at for r in stateful.live(spark, f"{tmp_path}/checkpoint", ["k"]).collect()}
    # The write at 9 renewed a; b and c are over at 12.
    assert live == {"a": T0 + dt.timedelta(minutes=19), "x": T0 + dt.timedelta(minutes=22)}
    assert {r.k: r.writes for r in feed.out()} == {"b": 1, "c": 1}
    # At the very end of its life a key still can be renewed.
    feed.send([minute("a", 19)])
    assert {r.k: r.writes for r in stateful.live(spark, f"{tmp_path}/checkpoint", ["k"]).collect()} == {"a": 3, "x": 1}
    last = feed.send([minute("a", 30), minute("z", 500)])
    over = sorted((r.k, r.writes, r.expired_at) for r in feed.out())
    assert over[:2] == [("a", 1, T0 + dt.timedelta(minutes=40)), ("a", 3, T0 + dt.timedelta(minutes=29))]
    assert held(last) == 1 < held(first)


def test_listener_rows_and_a_lag_alarm(spark, tmp_path):
    """Rows equal the progress; an old batch raises the alarm, a recent one clears it."""
    listener = stateful.ProgressMetrics()
    spark.streams.addListener(listener)
    try:
        feed = Feed(spark, tmp_path, "id long, ts timestamp_ntz", lambda stream: listener.observe(stream, "ts"))
        hour = lambda i, h: (i, T0 + dt.timedelta(hours=h))
        progress = [feed.send(rows) for rows in ([hour(1, 0), hour(2, 5)], [hour(3, 1), hour(4, 6)], [hour(5, 7), hour(6, 7)])]
        rows = sorted(listener.rows(spark).collect(), key=lambda r: r.batch)
    finally:
        spark.streams.removeListener(listener)
    shown = [p for q in progress for p in q.recentProgress if p["numInputRows"]]
    assert [(r.batch, r.records, r.state_rows) for r in rows] == [(p["batchId"], p["numInputRows"], 0) for p in shown] and len(rows) == 3
    lag = stateful.lag_metric(listener.rows(spark), F.col("newest"))
    states = alarms.evaluate(
        lag.select(F.lit("s").alias("s"), F.col("newest").alias("period"), "age_seconds"), ["s"], "age_seconds", 3600, ">",
        evaluation_periods=2, period_seconds=3600)
    assert [(r.period.hour, r.state) for r in states.orderBy("period").collect()] == [(5, "OK"), (6, "ALARM"), (7, "OK")]


def test_only_the_ends_of_a_slot_are_joined(spark, tmp_path):
    """300 alerts and 300 acknowledgements of one user in one slot: no alert meets all of them."""
    feed = Feed(spark, tmp_path, ALERTS, escalation)
    last = feed.send([at(1, i, i % 290, "error") for i in range(300)] + [at(1, 1000 + i, i % 250, "click") for i in range(300)])
    joined = [s["numRowsTotal"] for p in last.recentProgress for s in p["stateOperators"] if "Join" in s["operatorName"]]
    assert joined and max(joined) <= 300 + 4 * 4
    assert {(r.event_id, r.status) for r in feed.out()} == {(i, "RESOLVED") for i in range(300) if i % 290 <= 249}


def test_a_late_acknowledgement_hides_no_other(spark, tmp_path):
    feed = Feed(spark, tmp_path, ALERTS, escalation)
    feed.send([at(1, 1, 290, "error"), at(9, 2, 420, "other")])
    # The watermark is at 360: the first one is late, the last one too far, the one between counts.
    feed.send([at(1, 3, 350, "click"), at(1, 4, 400, "click"), at(1, 5, 595, "click")])
    feed.send([at(9, 6, 90_000, "other")])
    assert [(r.event_id, r.status) for r in feed.out()] == [(1, "RESOLVED")]
