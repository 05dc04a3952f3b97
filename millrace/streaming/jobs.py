"""Streaming jobs: parsing, cleaning with a dead-letter route, fan-out, statistics, state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter, StreamingQuery

from millrace.functions.scalar import decode_text
from millrace.operators import etl
from millrace.sources.tables import text_date_parts

# --- fixed values: delivery defaults -------------------------------------------
BATCH_SIZE = 100
BATCH_WINDOW = "5 seconds"
BUFFER_SECONDS = 300
BUFFER_MB = 5
BACKUP_PREFIX = "kinesis-backup/"
# -------------------------------------------------------------------------------

ENVELOPE = "Records array<struct<kinesis:struct<data:string>>>"
EVENT_SCHEMA = "id string, event_type string, user_id string, properties string"
HIVE_PARTS = ("year", "month", "day", "hour")


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json",
    start: str = "TRIM_HORIZON", max_files: int | None = None, max_bytes: str | None = None,
) -> DataFrame:
    """File stream. TRIM_HORIZON reads from the oldest file, LATEST the newest first."""
    return stream_options(spark.readStream.format(fmt).schema(schema), start, max_files, max_bytes).load(path)


def stream_options(
    reader: DataStreamReader, start: str = "TRIM_HORIZON", max_files: int | None = None, max_bytes: str | None = None
) -> DataStreamReader:
    if start not in ("TRIM_HORIZON", "LATEST"):
        raise ValueError("start must be TRIM_HORIZON or LATEST")
    reader = reader.option("latestFirst", str(start == "LATEST").lower())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader


def kafka_options(servers: str, topic: str, start: str = "LATEST", batch_size: int | None = None) -> dict[str, str]:
    """Options of a broker source; needs the Kafka package on the class path."""
    offsets = {"LATEST": "latest", "TRIM_HORIZON": "earliest"}[start]
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": offsets}
    return options | ({"maxOffsetsPerTrigger": str(batch_size)} if batch_size else {})


def buffered(writer: DataStreamWriter, seconds: int = BUFFER_SECONDS) -> DataStreamWriter:
    """Deliver at most every ``seconds``; bound the bytes with ``max_bytes`` of the source."""
    return writer.trigger(processingTime=f"{seconds} seconds")


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process everything unseen by ``checkpoint`` and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def parse_envelope(df: DataFrame, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Decode enveloped records: base64, then UTF-8, then JSON.

    Every record is judged alone, so a broken one fails neither its batch nor its
    neighbours. It keeps its raw text and an ``error``; good rows have none.
    """
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    raw = df.select(F.explode("Records").alias("r")).select(F.col("r.kinesis.data").alias("raw"))
    body = raw.withColumn("_body", decode_text(F.col("raw")))
    parsed = body.withColumn(
        "p", F.from_json("_body", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    error = F.when(F.col("_body").isNull(), "invalid base64").when(
        F.col("p").isNull() | F.col("p._corrupt").isNotNull(), "invalid JSON")
    names = [f.name for f in full.fields if f.name != "_corrupt"]
    return parsed.withColumn("error", error).select(
        *[F.when(F.col("error").isNull(), F.col(f"p.{c}")).alias(c) for c in names], "raw", "error")


def process_events(parsed: DataFrame, required: Sequence[str] = ("id", "event_type", "user_id")) -> DataFrame:
    """Parsed records in stored shape with the final ``error`` (parse or validation)."""
    shaped = parsed.withColumn("properties", F.coalesce("properties", F.lit("{}")))
    labelled = etl.label_required(shaped, required, "_invalid")
    return labelled.withColumn("error", F.coalesce("error", "_invalid")).drop("_invalid")


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Write one micro-batch. The batch number is the outermost partition and is
    replaced whole, so a replayed batch replaces itself and nothing else, also
    when its rows fall in other partitions than before. Rows meet by partition
    first: a batch writes few files to each."""
    rows = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy(*partition_by).parquet(f"{path.rstrip('/')}/batch={batch_id}")
    )


def etl_to_lake(
    stream: DataFrame, lake: str, dead_letters: str, counts: str, event_time: Column,
    parts: Sequence[str] = HIVE_PARTS,
) -> DataStreamWriter:
    """Decode, shape and validate; good rows go to the time layout, others to the
    dead-letter table, and processed/failed counts to a third."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = process_events(parse_envelope(batch)).persist()
        try:
            good = rows.where(F.col("error").isNull()).drop("raw", "error")
            good = good.withColumns(text_date_parts(event_time, parts))
            write_batch(good, lake, batch_id, parts)
            bad = rows.where(F.col("error").isNotNull()).select("raw", "id", "error")
            write_batch(bad, dead_letters, batch_id)
            summary = rows.agg(
                F.count(F.when(F.col("error").isNull(), 1)).alias("processed"),
                F.count(F.when(F.col("error").isNotNull(), 1)).alias("failed"))
            write_batch(summary, counts, batch_id)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(on_batch)


def fan_out(stream: DataFrame, consumers: Mapping[str, Column], root: str) -> DataStreamWriter:
    """One stream to several named consumers, each with its own filter and table."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, condition in consumers.items():
                write_batch(batch.where(condition), f"{root}/{name}", batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(on_batch)


def backup_writer(stream: DataFrame, root: str, prefix: str = BACKUP_PREFIX) -> DataStreamWriter:
    """Unchanged copy of a stream under the backup prefix; start it with a checkpoint of its own."""
    return stream.writeStream.format("parquet").option("path", f"{root.rstrip('/')}/{prefix}")


def hive_layout_writer(
    stream: DataFrame, ts: str, path: str, parts: Sequence[str] = HIVE_PARTS, fmt: str = "parquet", files_per_part: int = 4
) -> DataStreamWriter:
    """Append a stream to the zero-padded time layout through the exactly-once file sink.

    Rows meet by partition, so a micro-batch writes at most ``files_per_part``
    files to each; a live batch, nearly all of one hour, is split into as many tasks.
    """
    laid_out = stream.withColumns(text_date_parts(F.col(ts), parts))
    split = F.pmod(F.xxhash64(*stream.columns), F.lit(files_per_part))
    return (
        laid_out.repartition(*[F.col(p) for p in parts], split)
        .writeStream.format(fmt).option("path", path).partitionBy(*parts)
    )


def tumbling(
    stream: DataFrame, ts: str, width: str, delay: str, by: Sequence[str], aggregates: Mapping[str, Column]
) -> DataFrame:
    """Statistics per fixed window, final once the watermark passes the window."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    grouped = timed.groupBy(F.window(ts, width), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(
        F.col("window.start").cast("timestamp_ntz").alias("bin"), *by, *aggregates)


def dedupe(
    stream: DataFrame, ts: str, content: Sequence[str], delay: str, scope: Sequence[str] = (), splits: int = 8
) -> DataFrame:
    """Drop repeats of equal content (within ``scope``) that arrive within the delay.

    Copies first meet copies of the same input split, then the survivors meet.
    So a message that makes up much of the stream is spread over ``splits`` state
    partitions, and at most that many of its copies reach the second step.
    """
    body = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    hashed = stream.withColumns({
        ts: F.col(ts).cast("timestamp"), "_hash": F.sha2(body, 256),
        "_split": F.spark_partition_id() % F.lit(splits)})
    near = hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_hash", "_split", *scope])
    return near.dropDuplicatesWithinWatermark(["_hash", *scope]).drop("_hash", "_split")


def lag_rows(stream: DataFrame, ts: str, path: str, now: Column, alarm_seconds: int = BUFFER_SECONDS) -> DataStreamWriter:
    """Per micro-batch: records, oldest event and its age, and the alarm flag."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.min(ts).cast("timestamp"))
        summary = batch.agg(F.count(F.lit(1)).alias("records"), F.min(ts).alias("oldest"), age.alias("age_seconds"))
        judged = summary.withColumn("alarm", F.col("age_seconds") > alarm_seconds)
        write_batch(judged.where(F.col("records") > 0), path, batch_id)

    return stream.writeStream.foreachBatch(on_batch)


def progress_metrics(query: StreamingQuery) -> list[tuple[int, int, float]]:
    """(batch, input rows, rows per second) of the recent micro-batches."""
    return [
        (p["batchId"], p["numInputRows"], p.get("processedRowsPerSecond") or 0.0) for p in query.recentProgress
    ]


