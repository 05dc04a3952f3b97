"""Small helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Literal tables (rules, policies, targets) above this many rows are refused:
#: they are broadcast, so they must stay small whatever the data size is.
MAX_LITERAL_ROWS = 10_000

#: Number of hash buckets for sampling and splitting (0.01 % steps).
HASH_BUCKETS = 10_000

ARROW_TYPES = {
    T.StringType(): pa.string(),
    T.LongType(): pa.int64(),
    T.IntegerType(): pa.int32(),
    T.DoubleType(): pa.float64(),
    T.BooleanType(): pa.bool_(),
    T.DateType(): pa.date32(),
    T.TimestampNTZType(): pa.timestamp("us"),
    T.ArrayType(T.StringType()): pa.list_(pa.string()),
}


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Broadcast table of configuration rows, with a checked row bound."""
    if len(rows) > MAX_LITERAL_ROWS:
        raise ValueError(
            f"{len(rows)} literal rows exceed {MAX_LITERAL_ROWS}; store them as a table and join it"
        )
    struct = T._parse_datatype_string(schema)
    table = pa.table(
        {
            f.name: pa.array([r[i] for r in rows], type=ARROW_TYPES[f.dataType])
            for i, f in enumerate(struct.fields)
        }
    )
    return F.broadcast(spark.createDataFrame(table, schema=struct))


def hash_bucket(key: Column, buckets: int = HASH_BUCKETS) -> Column:
    """Stable bucket of a key: first 8 hex digits of its md5, modulo ``buckets``."""
    digest = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.conv(digest, 16, 10).cast("long") % F.lit(buckets)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def bin_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed-width time bin that holds ``ts``."""
    width = F.lit(seconds * 1_000_000).cast("long")
    us = micros(ts)
    return from_micros(us - F.pmod(us, width))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def count_if(condition: Column) -> Column:
    """Rows where the condition is true; 0 rather than NULL on empty input."""
    return F.count(F.when(condition, 1))


def pct(part: Column, whole: Column) -> Column:
    """Percentage as double, NULL when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def shared_dir(spark: SparkSession, name: str) -> str:
    """New directory below the shared folder named by ``spark.checkpoint.dir``.

    The setting is unset only in local sessions (tests); there, and nowhere
    else, a temporary folder of this machine is used.
    """
    base = configured_shared_dir(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix=f"run-{name}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def configured_shared_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``df`` with its 0-based position in ``order``, without one task that sorts all rows.

    Ranges are sorted side by side and numbered inside; a range starts where the
    ranges before it end (one row per range).
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id()).withColumn("_local", local)
    )
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per shuffle partition, whatever the number of rows.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_start") + F.col("_local")).drop("_range", "_local", "_start")
    )


def durable(df: DataFrame) -> DataFrame:
    """Frame stored in the reliable checkpoint folder, so that it is computed once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint(eager=True)
