"""Rolling limits against plain loops, with hot keys and small ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import alarms, limits

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "client string, ts timestamp_ntz, id long"


@pytest.fixture(scope="module")
def requests():
    """One client with most rows, a NULL client, rows without a time, equal times."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        client = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
        second = rng.choice([rng.randint(0, 40_000), rng.randint(20_000, 21_000)])
        rows.append((client, None if rng.random() < 0.01 else T0 + dt.timedelta(seconds=second), i))
    return rows


def by_client(rows):
    found = {}
    for client, ts, i in rows:
        if ts is not None:
            found.setdefault(client, []).append((ts, i))
    return {c: sorted(v) for c, v in found.items()}


@pytest.mark.parametrize("window,limit", [(60, 3), (600, 20), (1, 1)])
def test_over_limit(spark, requests, window, limit):
    frame = spark.createDataFrame(requests, SCHEMA).repartition(7)
    got = {r.id for r in limits.over_limit(frame, "client", "ts", "id", window, limit).collect()}
    want = set()
    for mine in by_client(requests).values():
        for n, (ts, i) in enumerate(mine):
            held = sum(1 for other, _ in mine[: n + 1] if other > ts - dt.timedelta(seconds=window))
            if held > limit:
                want.add(i)
    assert got == want and want


def test_burst_over_the_edge_of_a_day(spark):
    rows = [("x", dt.datetime(2024, 1, 1, 23, 59, 58) + dt.timedelta(seconds=i), i) for i in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = limits.rolling_offenders(frame, "client", "ts", "id", 10, 3).collect()
    assert [tuple(r) for r in found] == [("x", 1, rows[3][1], rows[3][1])]


@pytest.mark.parametrize("rate,burst", [(1, 2), (3, 40), (0, 25), (1000, 2000)])
def test_token_bucket(spark, requests, rate, burst):
    frame = spark.createDataFrame(requests, SCHEMA)
    got = {(r.client, r.tick): (r.requests, r.allowed) for r in limits.token_bucket(frame, "client", "ts", rate, burst, 60_000_000).collect()}
    want = {}
    for client, mine in by_client(requests).items():
        tokens, seen = burst, None
        for ts, _ in mine:
            tick = int((ts - dt.datetime(1970, 1, 1)).total_seconds()) // 60
            if seen is not None:
                tokens = min(burst, tokens + rate * (tick - seen))
            seen = tick
            n, allowed = want.get((client, tick), (0, 0))
            want[client, tick] = (n + 1, allowed + (tokens >= 1))
            tokens -= tokens >= 1
    assert got == want


def test_a_hot_client_is_cut_into_ranges(spark, monkeypatch):
    """One client alone: its bucket passes through all ranges."""
    rows = spark.range(4000).select(F.lit("one").alias("client"), F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("ts"), "id")
    seen = []
    monkeypatch.setattr(limits, "durable", lambda df: seen.append(df.cache()) or seen[-1])
    spent = limits.token_bucket(rows.unionByName(rows), "client", "ts", 1, 10).agg(F.sum("allowed"), F.count("*")).first()
    assert tuple(spent) == (10 + 3999, 4000)
    assert seen[0].select("_range").distinct().count() > 4


@pytest.mark.parametrize("interval", [1, 30, 900, 100_000])
def test_rolling_dedupe(spark, interval):
    rng = random.Random(interval)
    rows = []
    for i in range(1500):
        body = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        rows.append((body, None if rng.random() < 0.01 else T0 + dt.timedelta(seconds=rng.randint(0, 9000)), i))
    got = {r.id for r in limits.rolling_dedupe(spark.createDataFrame(rows, SCHEMA), ["client"], "ts", "id", interval * 1_000_000).collect()}
    want, untimed = set(), {}
    for body, ts, i in rows:
        if ts is None:
            untimed[body] = min(i, untimed.get(body, i))
    for mine in by_client(rows).values():
        last = None
        for ts, i in mine:
            if last is None or ts - last >= dt.timedelta(seconds=interval):
                want.add(i)
                last = ts
    assert got == want | set(untimed.values())


def test_dedupe_over_a_slot_edge(spark):
    at = lambda minute, second: dt.datetime(2024, 1, 1, 10, minute, second)
    rows = [("m", at(59, 59), 1), ("m", dt.datetime(2024, 1, 1, 11, 0, 1), 2), ("m", dt.datetime(2024, 1, 1, 11, 59, 59), 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.id for r in limits.rolling_dedupe(frame, ["client"], "ts", "id", 3_600_000_000).collect()) == [1, 3]
    assert limits.rolling_dedupe(frame.where("false"), ["client"], "ts", "id", 1).collect() == []


def test_no_alarm_over_a_gap(spark):
    rows = [("Errors", T0, 9.0), ("Errors", T0 + dt.timedelta(hours=3), 9.0), ("Errors", T0 + dt.timedelta(hours=4), 9.0)]
    stats = spark.createDataFrame(rows, "metric string, period timestamp_ntz, v double")
    states = {r.period.hour: r.state for r in alarms.default_states(stats, ["metric"], "metric", "v", period_seconds=3600).collect()}
    assert states == {0: "OK", 1: "OK", 2: "OK", 3: "OK", 4: "ALARM"}
    band = {r.period.hour: (r.v, r.state) for r in alarms.anomaly_band(stats, ["metric"], "v", min_history=1).collect()}
    assert band[1] == (None, "OK") and len(band) == 5
