"""Rolling limits: bursts over any window, token buckets and deduplication from the last kept message.

All of them follow each key in time order. Keys are not what is spread over tasks: rows are cut
into ranges of (key, time), so a key with a third of all rows is cut like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.common import durable, micros, numbered
from millrace.operators.timeline import carry_forward


def over_limit(df: DataFrame, key: str, ts: str, tie: str, window_seconds: int, limit: int) -> DataFrame:
    """(key, ts, tie) of every request at which the last ``window_seconds`` held more than ``limit`` of its key.

    That is so when the ``limit``-th request before it is less than the window away. Requests are numbered in
    (key, time, tie) order and meet the one ``limit`` numbers before them, so no key is one group. A NULL key is a key of its own;
    requests without a time take no part.
    """
    at = df.where(F.col(ts).isNotNull()).select(key, ts, tie, micros(F.col(ts)).alias("_us"))
    placed = numbered(at, [key, "_us", tie], "_n")
    earlier = placed.select(
        (F.col("_n") + limit).alias("_n"), F.col(key).alias("_key"), F.col("_us").alias("_then"))
    near = F.col("_us") - F.col("_then") < window_seconds * 1_000_000
    return placed.join(earlier, "_n").where(F.col(key).eqNullSafe(F.col("_key")) & near).select(key, ts, tie)


def rolling_offenders(df: DataFrame, key: str, ts: str, tie: str, window_seconds: int, limit: int) -> DataFrame:
    """Keys with a request over the limit in any rolling window: how many, the first and the last."""
    return over_limit(df, key, ts, tie, window_seconds, limit).groupBy(key).agg(
        F.count(F.lit(1)).alias("over"), F.min(ts).alias("first_over"), F.max(ts).alias("last_over"))


class Clamp:
    """x -> max(low, min(high, x + add)): what a run of refills and requests does to the tokens of a bucket.

    Such functions are closed under composition, so runs are summed up side by side.
    """

    def __init__(self, add: int = 0, low: int = 0, high: int = 0):
        self.add, self.low, self.high = add, low, high

    def __call__(self, x: int) -> int:
        return max(self.low, min(self.high, x + self.add))

    def then(self, add: int, low: int, high: int) -> Clamp:
        """This function followed by another one."""
        step = Clamp(add, low, high)
        return Clamp(self.add + add, step(self.low), step(self.high))


def _runs(rate: int, burst: int, key: str):
    """Per range the clamp of its last key: the only one that can go on in the next range."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = clamp = None
        number, start, seen = 0, 0, 0
        for frame in frames:
            for part, name, tick, n in zip(frame["_range"].tolist(), frame[key].tolist(), frame["tick"].tolist(), frame["requests"].tolist()):
                number = part
                name = (name is not None, name)
                if first is None:
                    first = name
                if name != last:
                    last, start, clamp = name, tick, Clamp(0, 0, burst)
                else:
                    clamp = clamp.then(rate * (tick - seen), 0, burst)
                seen = tick
                clamp = clamp.then(-n, 0, burst)
        if last is not None:
            yield pd.DataFrame({
                "_range": [number], "first_has": [first[0]], "first": [first[1]], "last_has": [last[0]], "last": [last[1]],
                "start": [start], "end": [seen], "add": [clamp.add], "low": [clamp.low], "high": [clamp.high],
            })

    return run


def _spend(rate: int, burst: int, key: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tokens, seen = None, 0, 0
        for frame in frames:
            allowed = []
            for name, tick, n, before, end in zip(
                frame[key].tolist(), frame["tick"].tolist(), frame["requests"].tolist(), frame["_tokens"].tolist(), frame["_end"].tolist()
            ):
                name = (name is not None, name)
                if name != last:
                    # Only the first key of a range can have a bucket from the range before.
                    go_on = last is None and before >= 0
                    tokens, seen, last = (before, end, name) if go_on else (burst, tick, name)
                tokens = min(burst, tokens + rate * (tick - seen))
                seen = tick
                allowed.append(min(n, tokens))
                tokens -= allowed[-1]
            yield frame[[key, "tick", "requests"]].assign(allowed=allowed)

    return run


def token_bucket(df: DataFrame, key: str, ts: str, rate: int = 1000, burst: int = 2000, tick_us: int = 1_000_000) -> DataFrame:
    """(key, tick, requests, allowed) of a token bucket per key: ``rate`` tokens a tick, ``burst`` at most and at first.

    Requests of a tick are counted first. Ranges then sum up what they do to the bucket of their last key (a
    :class:`Clamp`), the tokens at each range's start follow from one row per range, and each range spends them.
    A NULL key is a key of its own; requests without a time take no part.
    """
    spark = df.sparkSession
    tick = F.floor(micros(F.col(ts)) / F.lit(tick_us)).cast("long")
    counts = df.where(F.col(ts).isNotNull()).groupBy(F.col(key).cast("string").alias(key), tick.alias("tick")).agg(
        F.count(F.lit(1)).alias("requests"))
    ranged = durable(
        counts.repartitionByRange(key, "tick").sortWithinPartitions(key, "tick").withColumn("_range", F.spark_partition_id()))
    schema = "_range int, first_has boolean, first string, last_has boolean, last string, start long, end long, add long, low long, high long"
    # One row per shuffle partition.
    runs = sorted(ranged.mapInPandas(_runs(rate, burst, key), schema).collect())
    starts, before = [], None
    for r in runs:
        first, last = (r.first_has, r.first), (r.last_has, r.last)
        handed = before if before and before[0] == first else None
        if handed:
            starts.append((r["_range"], handed[1], handed[2]))
        tokens = burst
        if handed and first == last:
            tokens = min(burst, handed[1] + rate * (r.start - handed[2]))
        before = (last, Clamp(r.add, r.low, r.high)(tokens), r.end)
    handed = F.broadcast(spark.createDataFrame(starts, "_range int, _tokens long, _end long"))
    known = ranged.join(handed, "_range", "left").withColumns(
        {c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("_tokens", "_end")})
    return known.mapInPandas(_spend(rate, burst, key), f"`{key}` string, tick long, requests long, allowed long")


def rolling_dedupe(
    df: DataFrame, content: Sequence[str], ts: str, tie: str, interval_us: int, scope: Sequence[str] = ()
) -> DataFrame:
    """Drop messages of equal content less than ``interval_us`` after the last *kept* one.

    Every instant of a content has one next: the first instant at least the interval later. The kept ones are those reached from
    the content's first over these links. Links are doubled (next, next of next, ...), so a chain of
    any length takes as many joins as its length has bits, and joins are by (content, instant), never by content.
    Of messages at one instant the first by ``tie`` counts; messages without a time are one instant of their own.
    """
    body = F.to_json(F.struct(*content, *[c for c in scope if c not in content]), {"ignoreNullFields": "false"})
    keyed = df.withColumns({"_hash": F.unhex(F.sha2(body, 256)), "_us": micros(F.col(ts))})
    nodes = durable(keyed.groupBy("_hash", "_us").agg(F.min_by(F.struct(*df.columns), F.col(tie)).alias("_row")))
    instants = nodes.where(F.col("_us").isNotNull()).select("_hash", "_us")
    spans = instants.groupBy("_hash").agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"))
    reached = spans.select("_hash", F.col("lo").alias("_us"))
    # Contents that end within the interval keep their first message only.
    long = instants.join(spans.where(F.col("hi") - F.col("lo") >= interval_us).select("_hash"), "_hash", "left_semi")
    asked = long.select("_hash", (-F.col("_us") - interval_us).alias("_rev"), F.lit(1).alias("_kind"), F.col("_us").alias("_from"))
    given = long.select("_hash", (-F.col("_us")).alias("_rev"), F.lit(0).alias("_kind"), F.col("_us").alias("_at"))
    linked = carry_forward(
        asked.unionByName(given, allowMissingColumns=True), ["_hash"], ["_rev", "_kind"], F.col("_at"), "_next")
    jumps = durable(linked.where("_kind = 1 and _next is not null").select("_hash", F.col("_from").alias("_us"), "_next"))
    while jumps.head(1):
        onward = reached.join(jumps, ["_hash", "_us"]).select("_hash", F.col("_next").alias("_us"))
        reached = durable(reached.unionByName(onward))
        far = jumps.select("_hash", F.col("_us").alias("_next"), F.col("_next").alias("_far"))
        jumps = durable(jumps.join(far, ["_hash", "_next"]).select("_hash", "_us", F.col("_far").alias("_next")))
    kept = nodes.join(reached, ["_hash", "_us"], "left_semi").unionByName(nodes.where(F.col("_us").isNull()))
    return kept.select("_row.*")

