"""Stateful streaming on tables: upserts, change feeds, carried windows and alerts.

State lives in Parquet below a shared folder, written per micro-batch under the
batch number, so a replay after a lost executor or driver gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from millrace.common import durable, micros
from millrace.operators import timeline
from millrace.operators.cdc import reduce_changes

def _load(spark: SparkSession, path: str) -> DataFrame | None:
    """Table at ``path``; None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def finished(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the completed writes ``name=N`` below a path."""
    file_path = spark._jvm.org.apache.hadoop.fs.Path
    location = file_path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(location):
        return []
    names = [status.getPath().getName() for status in files.listStatus(location)]
    numbers = [int(n.partition("=")[2]) for n in names if n.startswith(f"{name}=")]
    return sorted(n for n in numbers if files.exists(file_path(f"{path}/{name}={n}/_SUCCESS")))


class KeyedTable:
    """Keyed table kept by a stream: an immutable base and one immutable delta per batch.

    A batch writes its own changes only, whatever the size of the table; a
    replayed batch replaces its own delta. The current image is the row with the
    highest ``seq`` per key over the newest complete base and the deltas after it.
    ``compact`` writes a new base beside the old one: it counts once its success
    marker is there, so a driver lost on the way leaves the old image intact.
    Removed keys stay as marked rows, so that an older change that arrives later
    cannot bring them back.
    """

    def __init__(self, path: str, keys: Sequence[str], seq: str):
        self.path, self.keys, self.seq = path.rstrip("/"), list(keys), seq

    def write(self, changes: DataFrame, batch_id: int) -> None:
        latest = reduce_changes(changes, self.keys, self.seq)
        latest.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{self.path}/delta/batch={batch_id}")

    def _parts(self, spark: SparkSession) -> tuple[list[str], int]:
        """Folders of the newest complete image, and the last batch in them."""
        bases = finished(spark, f"{self.path}/base", "upto")
        upto = bases[-1] if bases else -1
        deltas = [n for n in finished(spark, f"{self.path}/delta", "batch") if n > upto]
        parts = [f"{self.path}/base/upto={upto}"] if bases else []
        return parts + [f"{self.path}/delta/batch={n}" for n in deltas], max([upto, *deltas])

    def image(self, spark: SparkSession) -> DataFrame:
        """Current rows, removed ones with their mark."""
        parts, _ = self._parts(spark)
        return reduce_changes(spark.read.parquet(*parts), self.keys, self.seq)

    def compact(self, spark: SparkSession) -> None:
        """Fold the finished deltas into a new base."""
        parts, upto = self._parts(spark)
        if len(parts) > 1:
            self.image(spark).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
                f"{self.path}/base/upto={upto}")

    def rows(self, spark: SparkSession, op: str | None = None) -> DataFrame:
        """Current image without removed rows."""
        image = self.image(spark)
        return image if op is None else image.where(F.col(op) != "D").drop(op)


def apply_change_stream(stream: DataFrame, table: KeyedTable) -> DataStreamWriter:
    """Keep a table current with a change feed, whatever the batch boundaries."""
    return stream.writeStream.foreachBatch(table.write)


def keyed_state_stream(grouped: DataFrame, table: KeyedTable) -> DataStreamWriter:
    """Upsert the running aggregates of a stream; the table's ``seq`` grows with each update of a key."""
    return grouped.writeStream.outputMode("update").foreachBatch(table.write)


class SlidingCountStream:
    """Streaming form of :func:`timeline.sliding_count`.

    A row is final once the newest event is ``delay_us`` later. Each batch counts
    the rows that became final, with the rows of the window before them carried
    over. Rows that arrive later than that are stored apart and come back from
    ``finish`` with ``late`` set and no count; rows without a time have no count either.
    Within a live stream all new rows fall in the newest time slices; the count
    stays parallel because it aggregates instants before it shuffles.
    """

    def __init__(self, root: str, ts: str = "ts", window_us: int = timeline.MINUTE_US, delay_us: int = timeline.MINUTE_US):
        self.root, self.ts, self.window_us, self.delay_us = root.rstrip("/"), ts, window_us, delay_us
        self.out, self.late, self.carry = (f"{self.root}/{d}" for d in ("out", "late", "carry"))

    def _carried(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        return _load(spark, f"{self.carry}/batch={batch_id}")

    def _emit(self, rows: DataFrame, batch_id: int, horizon: int | None) -> None:
        us = micros(F.col(self.ts))
        final = rows if horizon is None else rows.where(us < horizon)
        if horizon is not None:
            final = final.unionByName(rows.where(us.isNull()))  # a row without a time is final at once
        counted = timeline.sliding_count(final, self.ts, self.window_us)
        counted.where(~F.col("_done")).drop("_done").write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        us = micros(F.col(self.ts))
        carried = self._carried(batch.sparkSession, batch_id - 1)
        fresh = batch.withColumn("_done", F.lit(False))
        if carried is not None:
            before = carried.agg(F.max(us)).first()[0]
            if before is not None:
                late = F.coalesce(us < before - self.delay_us, F.lit(False))
                fresh.where(late).drop("_done").write.mode("overwrite").parquet(f"{self.late}/batch={batch_id}")
                fresh = fresh.where(~late)
            fresh = fresh.unionByName(carried)
        rows = durable(fresh)
        newest = rows.agg(F.max(us)).first()[0]
        horizon = 0 if newest is None else newest - self.delay_us
        self._emit(rows, batch_id, horizon)
        kept = rows.where(us >= horizon - self.window_us).withColumn("_done", F.col("_done") | (us < horizon))
        kept.write.mode("overwrite").parquet(f"{self.carry}/batch={batch_id}")

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.on_batch)

    def finish(self, spark: SparkSession, last_batch: int) -> DataFrame:
        """Count what is still open after the end of the stream; returns all counts."""
        carried = self._carried(spark, last_batch)
        if carried is not None:
            self._emit(carried, last_batch + 1, None)
        counted = spark.read.parquet(self.out).drop("batch").withColumn("late", F.lit(False))
        late = _load(spark, self.late)
        if late is None:
            return counted
        missed = late.drop("batch").withColumn("late", F.lit(True))
        return counted.unionByName(missed, allowMissingColumns=True)


class AlertEscalationStream:
    """Streaming form of :func:`timeline.alert_escalation`.

    Alerts stay pending until acknowledged or until the newest event is past
    their deadline by ``delay_us``. Only the first acknowledgement is looked up,
    so nothing is paired and pending alerts are all that is kept, with recent
    acknowledgements in case an alert arrives after its own.
    """

    def __init__(self, root: str, key: str, ts: str, tie: str, is_alert: Column, is_ack: Column,
                 wait_seconds: int = 300, delay_us: int = timeline.MINUTE_US):
        self.root, self.key, self.ts, self.tie = root.rstrip("/"), key, ts, tie
        self.is_alert, self.is_ack = is_alert, is_ack
        self.wait_us, self.delay_us = wait_seconds * 1_000_000, delay_us
        self.out, self.carry = f"{self.root}/out", f"{self.root}/carry"

    def _decide(self, rows: DataFrame, batch_id: int, horizon: int | None) -> None:
        us = micros(F.col(self.ts))
        found = timeline.first_follow_up(
            rows.where(self.is_alert), rows.where(self.is_ack), self.key, self.ts, self.tie)
        in_time = F.coalesce(F.col("follow_up_us") <= us + self.wait_us, F.lit(False))
        status = F.when(in_time, "RESOLVED").when(
            F.lit(True) if horizon is None else us + self.wait_us < horizon, "ESCALATED")
        decided = durable(found.withColumn("status", status).drop("follow_up_us"))
        decided.where(F.col("status").isNotNull()).write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
        pending = decided.where(F.col("status").isNull()).drop("status")
        keep = pending.select(*rows.columns)
        if horizon is not None:
            keep = keep.unionByName(rows.where(self.is_ack & (us >= horizon)))
        keep.write.mode("overwrite").parquet(f"{self.carry}/batch={batch_id}")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        us = micros(F.col(self.ts))
        carried = _load(batch.sparkSession, f"{self.carry}/batch={batch_id - 1}")
        batch = batch.where(self.is_alert | self.is_ack)
        rows = durable(batch if carried is None else batch.unionByName(carried.select(*batch.columns)))
        newest = rows.agg(F.max(us)).first()[0]
        self._decide(rows, batch_id, 0 if newest is None else newest - self.delay_us)

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.on_batch)

    def finish(self, spark: SparkSession, last_batch: int) -> DataFrame:
        """Escalate what is still pending after the end of the stream; returns all decisions."""
        carried = _load(spark, f"{self.carry}/batch={last_batch}")
        if carried is not None:
            self._decide(carried, last_batch + 1, None)
        return spark.read.parquet(self.out).drop("batch")


class RedriveStream:
    """Retries with a dead-letter table.

    Each batch tries its new messages and those still pending from the batch
    before. A message that fails is pending again until it has been received
    ``max_receives`` times; then it goes to the dead-letter table. Everything is
    written under the batch number, so a replayed batch replaces itself.
    """

    def __init__(self, root: str, fails: Column, max_receives: int = 3):
        self.root, self.fails, self.max_receives = root.rstrip("/"), fails, max_receives
        self.done, self.pending, self.dead = (f"{self.root}/{d}" for d in ("done", "pending", "dead"))

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """``fails`` may use ``receives``, the number of this attempt."""
        fresh = batch.withColumn("receives", F.lit(0))
        waiting = _load(batch.sparkSession, f"{self.pending}/batch={batch_id - 1}")
        rows = fresh if waiting is None else fresh.unionByName(waiting.select(*fresh.columns))
        tried = durable(
            rows.withColumn("receives", F.col("receives") + 1)
            .withColumn("_failed", F.coalesce(self.fails, F.lit(False))))
        spent = F.col("receives") >= self.max_receives
        for path, part in ((self.done, ~F.col("_failed")), (self.pending, F.col("_failed") & ~spent),
                           (self.dead, F.col("_failed") & spent)):
            tried.where(part).drop("_failed").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.on_batch)

    def finish(self, spark: SparkSession, last_batch: int) -> DataFrame:
        """Retry what is pending after the end of the stream; returns all messages with their route."""
        waiting = _load(spark, f"{self.pending}/batch={last_batch}")
        if waiting is not None:
            nothing = waiting.drop("receives").where(F.lit(False))
            for number in range(last_batch + 1, last_batch + self.max_receives):
                self.on_batch(nothing, number)
        parts = [
            spark.read.parquet(path).drop("batch").withColumn("route", F.lit(route))
            for path, route in ((self.done, "DONE"), (self.dead, "DLQ"))
        ]
        return parts[0].unionByName(parts[1])

    def replay(self, spark: SparkSession) -> DataFrame:
        """Messages of the dead-letter table as new input."""
        return spark.read.parquet(self.dead).drop("batch", "receives")
