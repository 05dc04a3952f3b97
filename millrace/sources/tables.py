"""Partitioned table layouts: write, read back, convert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.common import shared_dir
from millrace.operators.etl import process_orders
from millrace.sources.files import read_csv

CODECS = {"GZIP": "gzip", "SNAPPY": "snappy", "UNCOMPRESSED": "none", "NONE": "none"}

_PARTS = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Run a block with a session setting and put the old one back."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def codec(name: str) -> str:
    """Map a delivery compression name to the writer option."""
    try:
        return CODECS[name.upper()]
    except KeyError:
        raise ValueError(f"compression {name!r} is not supported; use one of {sorted(CODECS)}") from None


def text_date_parts(ts: Column, parts: Sequence[str] = ("year", "month", "day", "hour")) -> dict[str, Column]:
    """Zero-padded text partition columns."""
    return {p: F.date_format(ts, _PARTS[p]) for p in parts}


def with_text_date_parts(df: DataFrame, ts: str, parts: Sequence[str]) -> DataFrame:
    return df.withColumns(text_date_parts(F.col(ts), parts))


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    fmt: str = "parquet",
    compression: str = "SNAPPY",
    mode: str = "overwrite",
    max_records_per_file: int = 5_000_000,
    whole: bool = False,
) -> None:
    """Write a Hive-style layout with few, even files.

    The rebalance hint groups rows by partition value but lets adaptive
    execution split a value that is too large for one task, so a hot day is
    written by many tasks while a sparse one still gets a single file. With
    ``mode="overwrite"`` only the partitions present in ``df`` are replaced,
    which makes a re-run idempotent; ``whole`` replaces everything below ``path``.
    """
    # Files follow the partition values, not the tasks, so merging tasks would
    # save no file and only make the write slower.
    with setting(df.sparkSession, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        (
            df.hint("rebalance", *[F.col(c) for c in partition_by])
            .write.mode(mode)
            .format(fmt)
            .option("compression", codec(compression))
            .option("partitionOverwriteMode", "static" if whole else "dynamic")
            .option("maxRecordsPerFile", max_records_per_file)
            .partitionBy(*partition_by)
            .save(path)
        )


def read_partitioned(
    spark: SparkSession, path: str, data_schema: T.StructType, partition_by: Sequence[str], fmt: str = "parquet"
) -> DataFrame:
    """Read a layout with text-typed partition columns (``month='01'`` keeps its zero)."""
    fields = [f for f in data_schema.fields if f.name not in partition_by]
    keys = [T.StructField(c, T.StringType()) for c in partition_by]
    return spark.read.format(fmt).schema(T.StructType(fields + keys)).load(path)


def write_and_read(
    df: DataFrame, partition_by: Sequence[str], name: str, fmt: str = "parquet"
) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    write_partitioned(df, path, partition_by, fmt)
    return read_partitioned(df.sparkSession, path, df.schema, partition_by, fmt)


def convert_format(
    spark: SparkSession,
    source: str,
    source_format: str,
    target: str,
    target_format: str,
    schema: T.StructType | str,
    compression: str = "SNAPPY",
    report: Observation | None = None,
    **options,
) -> DataFrame:
    """Rewrite files in another format under a declared schema; returns the target.

    ``report`` receives ``records_processed``, counted while writing.
    """
    frame = spark.read.format(source_format).schema(schema).options(**options).load(source)
    if report is not None:
        frame = frame.observe(report, F.count(F.lit(1)).alias("records_processed"))
    frame.write.mode("overwrite").format(target_format).option("compression", codec(compression)).save(target)
    return spark.read.format(target_format).schema(frame.schema).load(target)


def extract_keys(df: DataFrame, body: str, keys: Mapping[str, str]) -> DataFrame:
    """Partition columns taken from JSON paths of a payload. A missing key stays
    NULL and is stored under the default Hive partition."""
    return df.withColumns({name: F.get_json_object(body, path) for name, path in keys.items()})


def run_user_sql(spark: SparkSession, frames: Mapping[str, DataFrame], sql_queries: Sequence[str]) -> DataFrame:
    """Run user SQL text; ``{name}`` placeholders refer to the given frames."""
    return spark.sql("\n".join(sql_queries), **frames)


def append_lineage(
    spark: SparkSession, path: str, job_name: str, source_path: str, target_path: str, transformation_type: str,
    job_run_id: str,
) -> None:
    """Add the lineage record of a transformation; the record of a repeated run replaces itself."""
    record = spark.range(1).select(
        F.lit(job_name).alias("job_name"),
        F.lit(source_path).alias("source_path"),
        F.lit(target_path).alias("target_path"),
        F.lit(transformation_type).alias("transformation_type"),
        F.current_timestamp().alias("timestamp"),
        F.lit(job_run_id).alias("job_run_id"),
    )
    write_run = record.coalesce(1).withColumn("run", F.col("job_run_id")).withColumn("step", F.col("transformation_type"))
    write_run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "step").parquet(path)


def split_write(df: DataFrame, good: Column, good_path: str, bad_path: str) -> tuple[DataFrame, DataFrame]:
    """Write rows that pass and rows that fail to separate tables; returns both tables.

    The judged rows are persisted (memory, then disk) for the two writes.
    """
    judged = df.withColumn("_good", F.coalesce(good, F.lit(False))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        judged.where("_good").drop("_good").write.mode("overwrite").parquet(good_path)
        judged.where("not _good").drop("_good").write.mode("overwrite").parquet(bad_path)
    finally:
        judged.unpersist()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(good_path), spark.read.schema(df.schema).parquet(bad_path)


def append_features(df: DataFrame, path: str, event_time: str, run_id: str) -> None:
    """Add the feature rows of a run to an offline store, partitioned by event date.

    The run is the outer partition: a run that is repeated replaces its own
    rows, also where they fall on other dates than before.
    """
    dated = df.withColumn("event_date", F.to_date(event_time))
    write_partitioned(dated, f"{path.rstrip('/')}/run={run_id}", ["event_date"], whole=True)


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All runs of an offline store with their event date."""
    fields = [*schema.fields, T.StructField("event_date", T.DateType()), T.StructField("run", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(path).drop("run")


def clean_csv_to_lake(spark: SparkSession, source: str, target: str, schema: T.StructType | str, **options) -> None:
    """Daily batch: delimited files, cleaned and dated, into the partitioned zone. One write job."""
    clean = process_orders(read_csv(spark, source, schema, **options), stamp=True)
    write_partitioned(clean, target, ["order_year", "order_month", "order_day"])
