"""Log analysis: error and performance statistics, search, patterns, correlation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.common import bin_start, pct

BIN_SECONDS = 300

# --- fixed values: filters of the log statistics --------------------------------
ERROR_PATTERN = "ERROR"
REPORT_TYPE = "REPORT"
BATCH_MARKER = "batch (processing )?completed"
# ---------------------------------------------------------------------------------


def errors_by_bin(df: DataFrame, ts: str = "ts", seconds: int = BIN_SECONDS, pattern: str = ERROR_PATTERN) -> DataFrame:
    """Rows whose message matches the error pattern per time bin, newest first."""
    # A pattern without signs is looked for as it stands.
    found = F.col("message").contains(pattern) if re.fullmatch(r"[\w ]*", pattern) else F.col("message").rlike(pattern)
    errors = df.where(found)
    return (
        errors.groupBy(bin_start(F.col(ts), seconds).alias("bin"))
        .agg(F.count(F.lit(1)).alias("errors"))
        .orderBy(F.desc("bin"))
    )


def performance(df: DataFrame, by: Sequence[str], duration: str = "duration") -> DataFrame:
    """Average, maximum and minimum duration per group."""
    return df.groupBy(*by).agg(
        F.avg(duration).alias("avg_duration"),
        F.max(duration).alias("max_duration"),
        F.min(duration).alias("min_duration"),
    )


def performance_by_bin(df: DataFrame, ts: str = "ts", seconds: int = BIN_SECONDS) -> DataFrame:
    """Durations of the report records per time bin, newest first."""
    reports = df.where(F.col("record_type") == REPORT_TYPE)
    return performance(reports.withColumn("bin", bin_start(F.col(ts), seconds)), ["bin"]).orderBy(F.desc("bin"))


def errors_by_type(df: DataFrame, by: Sequence[str] = ("error_type",)) -> DataFrame:
    """ERROR rows per type, most frequent first."""
    return (
        df.where(F.col("level") == "ERROR").groupBy(*by)
        .agg(F.count(F.lit(1)).alias("errors"))
        .orderBy(F.desc("errors"), *by)
    )


def business_by(df: DataFrame, by: str = "pipeline", marker: str = BATCH_MARKER) -> DataFrame:
    """Records and success rate of the completed batches per group."""
    done = df.where(F.col("message").rlike(marker))
    return done.groupBy(by).agg(
        F.sum("record_count").alias("records"), F.avg("success_rate").alias("success_rate")
    )


def recent_errors(df: DataFrame, ts: str = "ts", tie: str = "log_id", n: int = 20) -> DataFrame:
    """Newest ``n`` ERROR rows; each task keeps its own ``n`` before they are merged."""
    return df.where(F.col("level") == "ERROR").orderBy(F.desc(ts), tie).limit(n)


def search(
    df: DataFrame,
    start: str,
    end: str,
    levels: Sequence[str] = (),
    services: Sequence[str] = (),
    limit: int = 100,
    ts: str = "ts",
    tie: str = "log_id",
) -> DataFrame:
    """Filtered log page, newest first, with the match ``total`` and ``has_more``."""
    t = F.col(ts)
    found = df.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))
    if levels:
        found = found.where(F.col("level").isin(list(levels)))
    if services:
        found = found.where(F.col("service").isin(list(services)))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    # The total is attached first, so that sort and limit stay adjacent and every
    # task keeps only its own best rows.
    counted = found.withColumn("total", total.scalar()).withColumn("has_more", F.col("total") > limit)
    return counted.orderBy(F.desc(ts), tie).limit(limit)


def correlate(df: DataFrame, correlation: str = "correlation_id", service: str = "service", ts: str = "ts") -> DataFrame:
    """Correlation ids that touch several services, with the services and time span.

    A group holds the distinct services only, and combines map-side.
    """
    return (
        df.groupBy(correlation)
        .agg(
            F.array_join(F.sort_array(F.collect_set(service)), ",").alias("services"),
            F.count(F.lit(1)).alias("rows"),
            F.min(ts).alias("first_seen"),
            F.max(ts).alias("last_seen"),
        )
        .where(F.col("services").contains(","))
    )


def mask_variables(message):
    """Message with quoted text, hexadecimal words and numbers replaced by markers."""
    quoted = F.regexp_replace(message, "\"[^\"]*\"", "<str>")
    hexed = F.regexp_replace(quoted, "0x[0-9a-fA-F]+", "<hex>")
    return F.regexp_replace(hexed, "[0-9]+", "<num>")


def patterns(df: DataFrame, message: str) -> DataFrame:
    """Rows and share per masked message; copies combine map-side."""
    counted = df.groupBy(mask_variables(F.col(message)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    # Summed over the patterns, so the subquery reuses the shuffle of the counts.
    total = counted.agg(F.sum("n").alias("total"))
    return counted.withColumn("share", pct(F.col("n"), total.scalar()))
