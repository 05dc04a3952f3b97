"""Ordered-data operators that stay parallel when one key or instant dominates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import all_of, durable, micros

MINUTE_US = 60_000_000


def sliding_count(
    df: DataFrame,
    ts: str = "ts",
    window_us: int = MINUTE_US,
    slice_us: int = 1_000_000,
    out: str = "record_count",
) -> DataFrame:
    """Per row: rows in the closed interval from ``window_us`` before ``ts`` to ``ts``.

    Equal to ``count(*) over (order by ts range interval .. preceding)``, which
    would run in one task. Here equal instants are counted first (map-side), so
    a slice never holds more than one entry per microsecond. The count at ``t``
    in slice ``s`` is what the ``k`` whole slices before ``s`` hold, plus the
    arrivals of slice ``s`` up to ``t``, minus the arrivals of slice ``s - k``
    that have left the interval by ``t``.
    """
    if window_us % slice_us:
        raise ValueError("window_us must be a multiple of slice_us")
    floor_to = lambda us, width: us - F.pmod(us, F.lit(width).cast("long"))
    rows = df.withColumn("_us", micros(F.col(ts)))
    timed = rows.where(F.col("_us").isNotNull())

    # Rows held by the whole slices before slice s: one entry per slice, copied
    # to its own block of slices and to the next one, so that a block sees all it needs.
    totals = timed.groupBy(floor_to(F.col("_us"), slice_us).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    block = floor_to(F.col("s"), window_us)
    copies = totals.withColumn("b", F.explode(F.array(block, block + window_us)))
    held = F.sum("n").over(Window.partitionBy("b").orderBy("s").rangeBetween(-window_us, -slice_us))
    base = (
        copies.withColumn("before", F.coalesce(held, F.lit(0)))
        .where(F.col("b") == block)
        .select("s", "before")
    )

    # Each instant arrives in its own slice and leaves in the slice one window later.
    arrivals = timed.groupBy("_us").agg(F.count(F.lit(1)).alias("n"))
    us = F.col("_us")
    moves = arrivals.select(F.inline(F.array(
        F.struct(floor_to(us, slice_us).alias("s"), us.alias("at"), F.col("n").alias("delta"), F.lit(True).alias("own")),
        F.struct((floor_to(us, slice_us) + window_us).alias("s"), (us + window_us + 1).alias("at"),
                 (-F.col("n")).alias("delta"), F.lit(False).alias("own")),
    )))
    upto = Window.partitionBy("s").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counts = (
        moves.withColumn("inside", F.sum("delta").over(upto))
        .where("own")
        .join(base, "s")
        .select(F.col("at").alias("_us"), (F.col("before") + F.col("inside")).cast("int").alias(out))
    )
    # A hot instant is one row on the right; adaptive execution splits its left rows.
    return rows.join(counts, "_us", "left").drop("_us")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current image per key: the row greatest in ``order``; reduces map-side."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first of several rows with the same keys."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Key equality in which NULL equals NULL, as it does in a window."""
    return all_of([F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    include_current: bool = True,
) -> DataFrame:
    """Add the last non-NULL ``value`` seen in key order up to each row.

    ``order`` columns ascend and should end in a unique tie-break. Rows, not
    keys, are what is balanced: all rows are cut into ranges of (keys, order),
    values are carried inside a range, and the last value of every key in a
    range (one row) is handed to the ranges after it. A key or instant with a
    third of all rows is therefore cut like any other.
    """
    last = 0 if include_current else -1
    seen = F.last("_v", ignorenulls=True)
    # Stored, because the range bounds are sampled: both uses below must see the same ranges.
    ranged = durable(
        df.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    )
    part_keys = ["_range", *keys]
    tails = ranged.groupBy(*part_keys).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_tail")
    )
    # One row per range in which the key occurs.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*part_keys, F.last("_tail", ignorenulls=True).over(earlier).alias("_carried")).where(
        F.col("_carried").isNotNull()
    )
    part = Window.partitionBy(*part_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    return (
        ranged.withColumn(out, seen.over(part)).alias("d")
        .join(carried.alias("h"), _same("d", "h", part_keys), "left")
        .select("d.*", "_carried")
        .withColumn(out, F.coalesce(F.col(out), F.col("_carried")))
        .drop("_v", "_range", "_carried")
    )


IMAGE_VIEWS = ("KEYS_ONLY", "NEW_IMAGE", "OLD_IMAGE", "NEW_AND_OLD_IMAGES")


def change_feed_images(
    df: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str], view: str = "NEW_AND_OLD_IMAGES"
) -> DataFrame:
    """Change records of a keyed table with the image columns the view type asks for."""
    if view not in IMAGE_VIEWS:
        raise ValueError(f"view must be one of {IMAGE_VIEWS}")
    new = [F.col(c).alias(f"new_{c}") for c in columns]
    if view == "KEYS_ONLY":
        return df.select(*keys, seq)
    if view == "NEW_IMAGE":
        return df.select(*keys, seq, *new)
    slim = df.select(*keys, seq, *columns)
    imaged = carry_forward(slim, keys, [seq], F.struct(*columns), "_old", include_current=False)
    old = [F.col(f"_old.{c}").alias(f"old_{c}") for c in columns]
    return imaged.select(*keys, seq, *(new if view == "NEW_AND_OLD_IMAGES" else []), *old)


def point_in_time(
    labels: DataFrame,
    features: DataFrame,
    key: str,
    label_time: str,
    feature_time: str,
    feature_columns: Sequence[str],
    tie: str,
) -> DataFrame:
    """Latest feature row at or before each label's time; NULLs where there is none.

    Labels and features are unioned and carried forward, so the cost is one sort
    of both and never a range join. ``tie`` (a column of both) orders equal times.
    A NULL key has no features, and a feature or label without a time meets none.
    """
    image = F.struct(F.col(feature_time).alias("feature_time"), *feature_columns)
    # Types are taken from a frame with the image column, NULL on the label side.
    right = features.select(
        F.col(key), micros(F.col(feature_time)).alias("_us"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"),
        image.alias("_image"),
    )
    kept = [c for c in labels.columns if c != key]
    left = labels.select(
        F.col(key), micros(F.col(label_time)).alias("_us"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"),
        F.struct(*kept).alias("_label"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    filled = carry_forward(both, [key], ["_us", "_kind", "_tie"], F.when(F.col(key).isNotNull() & F.col("_us").isNotNull(), F.col("_image")), "_found")
    return filled.where(F.col("_kind") == 1).select(
        key, "_label.*", F.col("_found.feature_time").alias("feature_time"),
        *[F.col(f"_found.{c}").alias(c) for c in feature_columns],
    )


def first_follow_up(
    rows: DataFrame, follow_ups: DataFrame, key: str, ts: str, tie: str
) -> DataFrame:
    """Add ``follow_up_us``: time of the first follow-up at or after each row, per key.

    A row without a key has none.
    """
    left = rows.select(
        F.col(key), (-micros(F.col(ts))).alias("_rev"), F.lit(1).alias("_kind"), (-F.col(tie)).alias("_tie"),
        F.struct(*[c for c in rows.columns if c != key]).alias("_row"),
    )
    right = follow_ups.select(
        F.col(key), (-micros(F.col(ts))).alias("_rev"), F.lit(0).alias("_kind"), (-F.col(tie)).alias("_tie"),
        micros(F.col(ts)).alias("_at"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    filled = carry_forward(both, [key], ["_rev", "_kind", "_tie"], F.when(F.col(key).isNotNull(), F.col("_at")), "follow_up_us")
    return filled.where(F.col("_kind") == 1).select(key, "_row.*", "follow_up_us")


def alert_escalation(
    alerts: DataFrame, acks: DataFrame, key: str, ts: str, tie: str, waits: Sequence[int] = (300,)
) -> DataFrame:
    """Per alert and wait in seconds: RESOLVED when acknowledged in time, else ESCALATED.

    Only the first acknowledgement after an alert matters, so no alert is paired
    with more than one and the cost does not grow with the acknowledgements per key.
    """
    found = first_follow_up(alerts, acks, key, ts, tie)
    each = found.withColumn("wait_seconds", F.explode(F.array(*[F.lit(w) for w in waits])))
    deadline = micros(F.col(ts)) + F.col("wait_seconds").cast("long") * 1_000_000
    in_time = F.coalesce(F.col("follow_up_us") <= deadline, F.lit(False))
    return each.withColumn("status", F.when(in_time, "RESOLVED").otherwise("ESCALATED")).drop("follow_up_us")


def content_dedupe_first(
    df: DataFrame, content: Sequence[str], ts: str, tie: str, interval_us: int, scope: Sequence[str] = ()
) -> DataFrame:
    """Keep the first of the messages with equal content in each fixed interval."""
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in content]), 256)
    us = micros(F.col(ts))
    keyed = df.withColumns({"_hash": digest, "_slot": us - F.pmod(us, F.lit(interval_us).cast("long"))})
    extra = [c for c in scope if c not in ("_hash", "_slot")]
    return first_per_key(keyed, ["_hash", "_slot", *extra], [ts, tie]).select(*df.columns)
