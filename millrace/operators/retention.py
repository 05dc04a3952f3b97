"""Retention, storage tiers, expiry."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
#: Days a zone keeps its rows; None keeps them for ever.
ZONE_DAYS = {"raw": 90, "processed": 365, "curated": 2555, "archive": None}

#: Age in days from which a tier applies, per storage profile; EXPIRED removes.
TIERS = {
    "prod": (("STANDARD", 0), ("INFREQUENT", 30), ("GLACIER", 90), ("DEEP_ARCHIVE", 365)),
    "nonprod": (("STANDARD", 0), ("INFREQUENT", 7), ("EXPIRED", 30)),
    "errors": (("STANDARD", 0), ("INFREQUENT", 30), ("EXPIRED", 90)),
    "quarantine": (("STANDARD", 0), ("INFREQUENT", 7), ("GLACIER", 30)),
}

GDPR_MAX_DAYS = 365
HIPAA_MIN_DAYS = 2555
# ------------------------------------------------------------------------------


def retention_severity(framework: Column, days: Column) -> Column:
    """ERROR when a framework's retention limit is broken, else INFO."""
    broken = ((framework == "gdpr") & (days > GDPR_MAX_DAYS)) | ((framework == "hipaa") & (days < HIPAA_MIN_DAYS))
    return F.when(F.coalesce(broken, F.lit(False)), "ERROR").otherwise("INFO")


def enforce(df: DataFrame, ts: str, zone: str, as_of: str) -> DataFrame:
    """Rows a zone still keeps at ``as_of``; a plain predicate, so partitions prune."""
    days = ZONE_DAYS[zone]
    if days is None:
        return df
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def age_days(ts: str, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("timestamp_ntz"), F.col(ts))


def tier_of(age: Column, profile: str) -> Column:
    """Storage tier for an age in days."""
    tier = F.lit(TIERS[profile][0][0])
    for name, start in TIERS[profile][1:]:
        tier = F.when(age >= start, F.lit(name)).otherwise(tier)
    return tier


def tier_summary(df: DataFrame, ts: str, as_of: str, profiles: Sequence[str], size: Column) -> DataFrame:
    """Rows and bytes per profile and tier from one scan."""
    age = age_days(ts, as_of)
    each = F.array(*[F.struct(F.lit(p).alias("profile"), tier_of(age, p).alias("tier")) for p in profiles])
    return (
        df.select(size.alias("_size"), F.inline(each))
        .groupBy("profile", "tier")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("bytes"))
    )


def live_rows(df: DataFrame, ttl: str, as_of: str) -> DataFrame:
    """Rows whose TTL (epoch seconds) is later than ``as_of``; no TTL never expires."""
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    return df.where(F.col(ttl).isNull() | (F.col(ttl) > now))


def with_ttl(df: DataFrame, ts: str, days: int = 30, out: str = "ttl") -> DataFrame:
    return df.withColumn(out, F.unix_timestamp(F.col(ts).cast("timestamp")) + days * 86_400)


def zones_kept(df: DataFrame, ts: str, as_of: str, zones: Mapping[str, int | None] = ZONE_DAYS) -> DataFrame:
    """Rows kept and dropped per zone from one scan."""
    age_us = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    each = F.array(*[
        F.struct(
            F.lit(zone).alias("zone"),
            (F.lit(True) if days is None else age_us <= F.lit(days * 86_400_000_000)).alias("keep"),
        )
        for zone, days in zones.items()
    ])
    return (
        df.select(F.inline(each)).groupBy("zone")
        .agg(F.count(F.when(F.col("keep"), 1)).alias("kept"), F.count(F.when(~F.col("keep"), 1)).alias("dropped"))
    )


def drop_partitions(spark: SparkSession, root: str, day: str, ts: str, cutoff: str) -> tuple[list[str], list[str]]:
    """Apply a cutoff to a table partitioned by ``day=YYYY-MM-DD``: (folders removed, folders rewritten).

    Days before the cutoff's go whole, by the name of their folder: nothing in them is read. Only the day the cutoff falls into
    is read, and written again without the rows before it, beside the old files, which it replaces at the end. Rows without a day stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    edge, _, time = cutoff.partition(" ")
    names = [s.getPath().getName() for s in files.listStatus(path(root)) if s.isDirectory()]
    days = {n: n.partition("=")[2] for n in names if re.fullmatch(rf"{re.escape(day)}=\d{{4}}-\d\d-\d\d", n)}
    gone = sorted(n for n, d in days.items() if d < edge)
    for name in gone:
        files.delete(path(f"{root}/{name}"), True)
    split = [n for n, d in days.items() if d == edge and time.strip("0:.")]
    for name in split:
        stored = spark.read.option("basePath", root).parquet(f"{root}/{name}")
        kept = stored.where(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))
        if kept.head(1):
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(root)
        else:
            files.delete(path(f"{root}/{name}"), True)
    return gone, split
