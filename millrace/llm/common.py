"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.common import shared_dir

#: White space of the contracts: space and U+0009 to U+000D.
BLANK = "\\x20\\x09-\\x0D"


def fresh(name: str) -> str:
    """Column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Frame written once to the shared folder and read back from there.

    Cuts the lineage: what follows survives the loss of any executor without
    recomputing what came before.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables a job passes through, below one shared folder; what later steps no longer read is removed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_dir(spark, name)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`staged`; the frame can be handed to :meth:`drop`."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that no frame reads any more."""
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, keys: Sequence[Column], rank: str, name: str = "ranked") -> DataFrame:
    """``df`` with its 0-based position in the order of ``keys``; ties in any order.

    Ranges are sorted side by side and numbered inside; the offset of a range is
    the sum of the row counts of those before it (one row per range).
    """
    part, local, n, offset = (fresh(x) for x in ("part", "local", "n", "offset"))
    placed = staged(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(part, F.spark_partition_id())
        .withColumn(local, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        name,
    )
    counts = placed.groupBy(part).agg(F.count("*").alias(n))
    # One row per shuffle partition: bounded by the number of tasks, not by rows.
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(offset))
    return (
        placed.join(F.broadcast(offsets), part)
        .withColumn(rank, F.col(local) + F.col(offset))
        .drop(part, local, offset)
    )


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; NULL becomes the empty text."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
