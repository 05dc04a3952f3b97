"""Change data: table selection, applying changes, reconciliation, erasure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_tables(
    changes: DataFrame, include: Sequence[str] = (), schema_pattern: str = "%",
    schema_column: str = "schema_name", table_column: str = "table_name",
) -> DataFrame:
    """Keep changes of the listed tables (all when none are listed) in matching schemas."""
    kept = changes if schema_pattern == "%" else changes.where(F.col(schema_column).like(schema_pattern))
    return kept.where(F.col(table_column).isin(list(include))) if include else kept


def reduce_changes(changes: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Latest change per key; combines map-side, so a hot key is one row per task."""
    rest = [c for c in changes.columns if c not in keys]
    return (
        changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_c")).select(*keys, "_c.*")
    )


def apply_changes(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq", op: str = "op"
) -> DataFrame:
    """Base table after the changes: the latest change per key wins, ``D`` removes."""
    data = [c for c in base.columns if c not in keys]
    last = reduce_changes(changes, keys, seq).select(
        *keys, F.col(op).alias("_op"), *[F.col(c).alias(f"_new_{c}") for c in data]
    )
    joined = base.withColumn("_had", F.lit(True)).join(last, list(keys), "full_outer")
    changed = F.col("_op").isNotNull()
    return joined.where(~F.coalesce(F.col("_op") == "D", F.lit(False))).select(
        *keys, *[F.when(changed, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in data]
    )


def reconcile(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: MATCH, MISMATCH, MISSING_IN_TARGET or EXTRA_IN_TARGET.

    Also names the differing columns. Keys are unique on both sides.
    """
    s = source.select(*keys, F.struct(*columns).alias("_s"))
    t = target.select(*keys, F.struct(*columns).alias("_t"))
    differs = [F.when(~F.col(f"_s.{c}").eqNullSafe(F.col(f"_t.{c}")), F.lit(c)) for c in columns]
    status = (
        F.when(F.col("_t").isNull(), "MISSING_IN_TARGET")
        .when(F.col("_s").isNull(), "EXTRA_IN_TARGET")
        .when(~F.col("_s").eqNullSafe(F.col("_t")), "MISMATCH")
        .otherwise("MATCH")
    )
    columns_text = F.when(F.col("status") == "MISMATCH", F.concat_ws(",", F.array_compact(F.array(*differs))))
    return (
        s.join(t, list(keys), "full_outer")
        .withColumn("status", status)
        .withColumn("differing", columns_text)
        .select(*keys, "status", "differing")
    )


def unseen(inputs: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Inputs whose id the ledger does not hold."""
    return inputs.join(ledger.select(key).distinct(), key, "left_anti")


def erase_subjects(df: DataFrame, subject: str, requests: DataFrame, request_key: str) -> DataFrame:
    """Rows without those of the subjects that asked for erasure.

    No hint: the requests are broadcast when the optimizer measures them as
    small, and a shuffled anti join, split on skew, does it otherwise.
    """
    asked = requests.select(F.col(request_key).alias(subject)).distinct()
    return df.join(asked, subject, "left_anti")


def erasure_counts(df: DataFrame, subject: str, requests: DataFrame, request_key: str, table_name: str) -> DataFrame:
    """Removed and kept rows of one table. Rows are counted per subject before the join."""
    per_subject = df.groupBy(subject).agg(F.count(F.lit(1)).alias("_n"))
    asked = requests.select(F.col(request_key).alias(subject), F.lit(True).alias("_asked")).distinct()
    return per_subject.join(asked, subject, "left").agg(
        F.coalesce(F.sum(F.when(F.col("_asked"), F.col("_n"))), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(F.when(F.col("_asked").isNull(), F.col("_n"))), F.lit(0)).alias("kept"),
    ).select(F.lit(table_name).alias("table_name"), "removed", "kept")


def overlay_settings(base: DataFrame, overrides: DataFrame, entity: str = "entity", path: str = "path", value: str = "value") -> DataFrame:
    """Settings per entity and nested path: an override wins, other paths stay.

    An override at a path replaces what the base holds at that exact path.
    """
    b = base.select(entity, path, F.col(value).alias("_base"), F.lit(True).alias("_in_base"))
    o = overrides.select(entity, path, F.col(value).alias("_over"), F.lit(True).alias("_in_over"))
    origin = F.when(F.col("_in_over").isNull(), "base").when(F.col("_in_base").isNull(), "added").otherwise("override")
    return b.join(o, [entity, path], "full_outer").select(
        entity, path, F.when(F.col("_in_over"), F.col("_over")).otherwise(F.col("_base")).alias(value),
        origin.alias("origin"),
    )


def star_enrich(
    facts: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Facts with the region of their customer.

    The three dimensions are joined with each other first, so the facts meet one
    narrow (customer, region) table; it is broadcast only if measured small.
    """
    dims = (
        customer.select("c_custkey", "c_nationkey")
        .join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("region"))
    )
    return facts.join(dims, "o_custkey")


def attempts_exceeded(attempts: DataFrame, message_id: str, max_receive_count: int = 3) -> DataFrame:
    """Messages received more often than allowed go to the dead-letter route."""
    return (
        attempts.groupBy(message_id).agg(F.count(F.lit(1)).alias("receives"))
        .withColumn("route", F.when(F.col("receives") > max_receive_count, "DLQ").otherwise("QUEUE"))
    )
