"""Batch cleaning: critical-column filter, whole-row dedupe, derived date columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.common import all_of

CRITICAL_COLUMNS = ("customer_id", "order_date", "amount")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row dedupe. Copies collapse in the map-side combine, so a row that
    makes up a third of the input costs one row per map task in the shuffle."""
    return df.dropDuplicates()


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(all_of([F.col(c).isNotNull() for c in columns]))


def add_date_parts(df: DataFrame, date_column: str = "order_date", prefix: str = "order") -> DataFrame:
    return df.withColumns(
        {
            f"{prefix}_year": F.year(date_column),
            f"{prefix}_month": F.month(date_column),
            f"{prefix}_day": F.dayofmonth(date_column),
        }
    )


def process_orders(
    df: DataFrame,
    critical: Sequence[str] = CRITICAL_COLUMNS,
    date_column: str = "order_date",
    stamp: bool = False,
) -> DataFrame:
    """Dedupe, keep rows whose critical columns are all set, add date parts.

    The null filter comes first: it commutes with the dedupe, reaches the scan
    as a pushed predicate, and spares the shuffle the rejected rows.
    """
    clean = add_date_parts(distinct_rows(drop_null_rows(df, critical)), date_column)
    if stamp:
        clean = clean.withColumn("processed_timestamp", F.current_timestamp())
    return clean


def transform_event(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Project an event to its stored shape; absent properties become ``{}``."""
    return df.select(
        "id",
        "event_type",
        "user_id",
        F.coalesce("properties", F.lit("{}")).alias("properties"),
        *([] if processed_at is None else [processed_at.alias("processed_at")]),
    )


def label_required(
    df: DataFrame,
    required: Sequence[str] = ("id", "event_type", "user_id"),
    error_column: str = "error",
) -> DataFrame:
    """Add the error text of rows that lack a required field, NULL for good rows."""
    good = all_of([F.col(c).isNotNull() for c in required])
    return df.withColumn(error_column, F.when(~good, F.lit("Validation failed")))


def transform_hook(df: DataFrame, hook: Callable[[Iterator], Iterator] | None, schema: str | None = None) -> DataFrame:
    """Optional user code per Arrow batch of a partition; without a hook the frame is unchanged.

    ``hook`` gets and yields pandas frames. It sees the rows of one task batch by
    batch, never a whole group.
    """
    if hook is None:
        return df
    return df.mapInPandas(hook, schema or df.schema)


def apply_transformation_rules(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Run an ordered list of declarative rules.

    Each rule has ``op`` and its own fields: ``rename`` (from, to), ``cast``
    (column, type), ``drop`` (column), ``default`` (column, value), ``expr``
    (column, sql) and ``filter`` (sql).
    """
    steps = {
        "rename": lambda d, r: d.withColumnRenamed(r["from"], r["to"]),
        "cast": lambda d, r: d.withColumn(r["column"], F.col(r["column"]).cast(r["type"])),
        "drop": lambda d, r: d.drop(r["column"]),
        "default": lambda d, r: d.withColumn(
            r["column"], F.coalesce(F.col(r["column"]), F.lit(r["value"]))
        ),
        "expr": lambda d, r: d.withColumn(r["column"], F.expr(r["sql"])),
        "filter": lambda d, r: d.where(F.expr(r["sql"])),
    }
    for rule in rules:
        if rule["op"] not in steps:
            raise ValueError(f"unknown transformation rule {rule['op']!r}")
        df = steps[rule["op"]](df, rule)
    return df
