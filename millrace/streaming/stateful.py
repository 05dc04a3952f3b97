"""Stateful streaming on Spark's own state: joins, windows and sessions that expire with the watermark."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

#: Event time under a watermark, beside the column it was made from.
AT = "_at"


def timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    return stream.withColumn(AT, F.col(ts).cast("timestamp")).withWatermark(AT, delay)


@F.arrow_udf(T.IntegerType())
def _ends(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Per row of (key, slot, time): 1 if its task has none later of its key and slot so far, plus 2 if none earlier.

    A batch gives one row of each kind at most per key and slot, whatever the order of its rows.
    """
    seen: dict[tuple, tuple[int, int]] = {}
    for keys, slots, times in batches:
        out = np.zeros(len(times), np.int32)
        here: dict[tuple, tuple[int, int]] = {}
        at = times.to_pylist()
        for row, name in enumerate(zip(keys.to_pylist(), slots.to_pylist())):
            low, high = here.get(name, (row, row))
            here[name] = (row if at[row] < at[low] else low, row if at[row] > at[high] else high)
        for name, (low, high) in here.items():
            first, last = seen.get(name, (at[low] + 1, at[high] - 1))
            out[low] |= 2 * (at[low] < first)
            out[high] |= 1 * (at[high] > last)
            seen[name] = (min(first, at[low]), max(last, at[high]))
        yield pa.array(out)


# Depends on the other rows of its task: it stays where it is put.
_ends = _ends.asNondeterministic()


def escalate(
    stream: DataFrame, key: str, id_col: str, ts: str, is_alert: Column, is_ack: Column, wait: str, delay: str, splits: int = 4
) -> DataFrame:
    """One row (``id_col``, ``key``, ``ts``, status) per alert: RESOLVED once an acknowledgement of its key follows
    within ``wait``, ESCALATED once the watermark rules one out.

    A left outer join of the stream with itself by key and time interval: alerts and acknowledgements wait in the state
    store and leave it as the watermark passes their intervals. Acknowledgements go to all ``splits`` parts of a key
    and each alert to one, so a key with many alerts is not one state partition.

    Alerts and acknowledgements of a key do not all meet: time is cut into slots of ``wait``. An alert is acknowledged in time if and only if
    the last acknowledgement of its slot is not before it or the first one of the next slot is within ``wait``. So of the
    acknowledgements that a micro-batch brings for a key and a slot only the first and the last are joined, and an alert meets two a
    batch, not all of its key. Late ones are dropped before that choice. An alert without a key or a time is never acknowledged. Rows later than ``delay`` are dropped and counted by
    Spark (``numRowsDroppedByWatermark``). ``id_col`` must tell alerts apart.
    """
    rows = timed(stream, ts, delay)
    part = F.pmod(F.xxhash64(id_col), F.lit(splits)).cast("int")
    kept = [c for c in dict.fromkeys((id_col, key))]
    # Texts with a mark of their own: a NULL key equals nothing, and its alert still comes out.
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("none"))
    # Tests that read the event time are not moved below the watermark: rows of other kinds advance it too.
    known = F.col(AT).isNotNull()
    us = F.unix_micros(AT)
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {wait}"))
    slot = us - F.pmod(us, width)
    alerts = rows.where(F.when(known, is_alert)).select(
        *kept, F.col(AT).alias("alert_at"), name.alias("alert_key"), part.alias("alert_part"), slot.alias("alert_slot"))
    # One of an instant is enough. This step also drops the late ones, which must not stand for others of their slot.
    timely = rows.where(F.when(known, is_ack & F.col(key).isNotNull())).select(
        F.col(AT).alias("ack_at"), name.alias("ack_key"), slot.alias("slot"), us.alias("us"), width.alias("width"),
    ).dropDuplicatesWithinWatermark(["ack_key", "ack_at"])
    ends = timely.repartition("ack_key", "slot").withColumn("ends", _ends("ack_key", "slot", "us"))
    # The last one is for alerts of its slot, the first one for those of the slot before.
    acks = ends.where("ends > 0").select(
        "ack_at", "ack_key",
        F.explode(F.expr("filter(array(if(ends & 1 > 0, slot, null), if(ends & 2 > 0, slot - width, null)), x -> x is not null)")).alias("ack_slot"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("ack_part"))
    within = (
        (F.col("alert_key") == F.col("ack_key")) & (F.col("alert_part") == F.col("ack_part")) & (F.col("alert_slot") == F.col("ack_slot"))
        & (F.col("ack_at") >= F.col("alert_at")) & (F.col("ack_at") <= F.col("alert_at") + F.expr(f"interval {wait}"))
    )
    met = alerts.join(acks, within, "left_outer").select(
        *kept, "alert_at", F.when(F.col("ack_at").isNotNull(), "RESOLVED").otherwise("ESCALATED").alias("status"))
    # State of this step lives as long as the join can still produce rows of the alert.
    once = met.dropDuplicatesWithinWatermark([id_col]).select(
        *kept, F.col("alert_at").cast("timestamp_ntz").alias(ts), "status")
    untimed = stream.where(is_alert & F.col(ts).isNull()).select(
        *kept, F.lit(None).cast("timestamp_ntz").alias(ts), F.lit("ESCALATED").alias("status"))
    return once.unionByName(untimed)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _inside(own: pa.Array, leaving: pa.Array, between: pa.Array, window: pa.Array) -> pa.Array:
    """Per row of a slice: rows up to it in its slice, all of the whole slices before, and those of the oldest slice not yet gone."""
    out = []
    for mine, old, whole, width in zip(own.to_pylist(), leaving.to_pylist(), between.to_pylist(), window.to_pylist()):
        at, gone = np.asarray(mine, np.int64), np.asarray(old or [], np.int64)
        counts = whole + np.searchsorted(at, at, "right") + len(gone) - np.searchsorted(gone, at - width, "left")
        out.append(counts.tolist())
    return pa.array(out, pa.list_(pa.int32()))


def sliding_count(
    stream: DataFrame, ts: str = "ts", window_seconds: int = 60, slices: int = 1, delay: str = "1 minute", out: str = "record_count"
) -> DataFrame:
    """Streaming form of the sliding count: per row, rows in the closed interval of ``window_seconds`` up to it.

    Two chained window aggregates. The first gathers each slice (``window_seconds / slices``) once the watermark has passed it. The
    second gives every slice to the window that ends with it and to the next ``slices`` ones as *between* or *leaving*, so a
    window holds the rows of two slices and counts of the others; with more slices a task holds fewer rows, at one
    count more a slice. A row without a time comes out at once, without a count; rows later than ``delay`` are
    dropped and counted by Spark (``numRowsDroppedByWatermark``).
    """
    if window_seconds % slices:
        raise ValueError("slices must divide window_seconds")
    width = window_seconds // slices
    names = stream.columns
    us = F.unix_micros(AT)
    per_slice = timed(stream, ts, delay).where(F.col(AT).isNotNull()).groupBy(F.window(AT, f"{width} seconds").alias("slice")).agg(
        F.collect_list(F.struct(us.alias("us"), F.struct(*names).alias("row"))).alias("rows"), F.count(F.lit(1)).alias("n"))
    seen = per_slice.select(
        F.window(F.window_time("slice"), f"{window_seconds + width} seconds", f"{width} seconds").alias("w"),
        F.col("slice.start").alias("start"), F.array_sort("rows", lambda a, b: F.signum(a["us"] - b["us"]).cast("int")).alias("rows"), "n")
    own = F.col("start") == F.col("w.end") - F.expr(f"interval {width} seconds")
    leaving = F.col("start") == F.col("w.start")
    met = seen.groupBy("w").agg(
        F.first(F.when(own, F.col("rows")), ignorenulls=True).alias("own"),
        F.first(F.when(leaving, F.col("rows.us")), ignorenulls=True).alias("leaving"),
        F.coalesce(F.sum(F.when(~own & ~leaving, F.col("n"))), F.lit(0)).alias("between"))
    counted = met.where(F.col("own").isNotNull()).select(
        F.arrays_zip(
            F.col("own.row").alias("row"),
            _inside("own.us", "leaving", "between", F.lit(window_seconds * 1_000_000)).alias("n"),
        ).alias("each"))
    each = counted.select(F.explode("each").alias("e")).select("e.row.*", F.col("e.n").alias(out))
    untimed = stream.where(F.col(ts).isNull()).withColumn(out, F.lit(None).cast("int"))
    return each.unionByName(untimed)


def expired(stream: DataFrame, keys: Sequence[str], ts: str, ttl: str, delay: str) -> DataFrame:
    """(keys, first_seen, last_seen, writes, expired_at) of every key whose TTL ran out: each write renews it.

    Sessions with the TTL as gap: live keys are in the state store only (:func:`live`), and a key leaves it when the watermark passes its
    last write plus the TTL. A write after that starts a new life.
    Writes without a time or key never expire and are not tracked.
    """
    present = reduce(and_, [F.col(key).isNotNull() for key in keys])
    rows = timed(stream, ts, delay).where(F.when(F.col(AT).isNotNull(), present))
    life = rows.groupBy(F.session_window(AT, ttl).alias("life"), *keys).agg(
        F.min(AT).alias("first"), F.max(AT).alias("last"), F.count(F.lit(1)).alias("writes"))
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return life.select(*keys, ntz("first").alias("first_seen"), ntz("last").alias("last_seen"), "writes", ntz("life.end").alias("expired_at"))


def live(spark: SparkSession, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """(keys, first_seen, last_seen, writes, expires_at) of the lives :func:`expired` keeps in the state of its checkpoint.

    The state store itself is the table of live keys; it is read with Spark's state reader while no batch writes it.
    """
    state = spark.read.format("statestore").load(checkpoint)
    ntz = lambda c, name: F.col(f"value.{c}").cast("timestamp_ntz").alias(name)
    return state.select(
        *[F.col(f"value.{k}").alias(k) for k in keys], ntz("min", "first_seen"), ntz("max", "last_seen"),
        F.col("value.count").alias("writes"), ntz("session_window.end", "expires_at"))


class ProgressMetrics(StreamingQueryListener):
    """Metric rows from the progress of streaming queries, and from what their frames ``observe`` under ``name``.

    One row per micro-batch with input: rows read, rows a second, rows in state, rows dropped as late, and the observed values.
    """

    SCHEMA = (
        "query string, batch long, records long, rows_per_second double, state_rows long, late_rows long, oldest timestamp, newest timestamp"
    )

    def __init__(self, name: str = "lag"):
        self.name, self._rows, self._lock = name, [], threading.Lock()

    def onQueryStarted(self, event):  # noqa: N802 - names of Spark's interface
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if not p.numInputRows or seen is None:
            return
        state = list(p.stateOperators)
        row = (
            str(p.id), p.batchId, seen["records"], float(p.processedRowsPerSecond or 0.0), sum(s.numRowsTotal for s in state),
            sum(s.numRowsDroppedByWatermark for s in state), seen["oldest"], seen["newest"],
        )
        with self._lock:
            self._rows.append(row)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def observe(self, stream: DataFrame, ts: str) -> DataFrame:
        """``stream`` with its rows and its oldest and newest time reported per micro-batch, in the pass that is made anyway."""
        at = F.col(ts).cast("timestamp")
        return stream.observe(self.name, F.count(F.lit(1)).alias("records"), F.min(at).alias("oldest"), F.max(at).alias("newest"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The metric rows so far (one per micro-batch)."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        with self._lock:
            found = list(self._rows)
        return spark.createDataFrame(found, self.SCHEMA)


def lag_metric(metrics: DataFrame, now: Column) -> DataFrame:
    """Metric rows as (batch, records, oldest, newest, age_seconds): how far the oldest record of a batch lies behind ``now``."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("oldest")
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("oldest", "newest")]
    return metrics.select("batch", "records", *ntz, age.alias("age_seconds"))
