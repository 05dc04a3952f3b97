"""Data-quality measures: every check is one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.common import count_if, pct

def _unpivot(one_row: DataFrame, names: Sequence[str], name_column: str, fields: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate with struct columns into one row per name."""
    items = [
        F.struct(F.lit(n).alias(name_column), *[F.col(f"_{i}.{f}").alias(f) for f in fields])
        for i, n in enumerate(names)
    ]
    return one_row.select(F.inline(F.array(*items)))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: null_count, total_count, completeness_percentage (NULL on empty input)."""
    total = F.count(F.lit(1))
    aggs = [
        F.struct(
            count_if(F.col(c).isNull()).alias("null_count"),
            total.alias("total_count"),
            pct(F.count(c), total).alias("completeness_percentage"),
        ).alias(f"_{i}")
        for i, c in enumerate(columns)
    ]
    fields = ["null_count", "total_count", "completeness_percentage"]
    return _unpivot(df.agg(*aggs), columns, "column_name", fields)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: exact distinct values per column as ``u0``, ``u1``, ... (NULL not counted).

    Rows become (column, value) pairs that are combined in the map tasks before
    one shuffle; any number of columns is counted side by side.
    """
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)
    ])
    values = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.lit(1))
    counts = values.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(*[
        F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"u{i}") for i in range(len(columns))
    ])


def _null_seen(column: str) -> Column:
    return F.coalesce(F.max(F.col(column).isNull().cast("long")), F.lit(0).cast("long"))


def uniqueness(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Per column: distinct values (NULL is one value), total and percentage."""
    base = df.agg(
        F.count(F.lit(1)).alias("total_count"), *[_null_seen(c).alias(f"z{i}") for i, c in enumerate(columns)],
        *([F.approx_count_distinct(c).alias(f"u{i}") for i, c in enumerate(columns)] if approximate else []),
    )
    flat = base if approximate else base.crossJoin(distinct_counts(df, columns))  # one row each
    items = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.col(f"u{i}") + F.col(f"z{i}")).alias("unique_count"),
            F.col("total_count"),
            pct(F.col(f"u{i}") + F.col(f"z{i}"), F.col("total_count")).alias("uniqueness_percentage"),
        )
        for i, c in enumerate(columns)
    ]
    return flat.select(F.inline(F.array(*items)))


def validity(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Per named condition: rows for which it is true; a NULL condition is invalid."""
    total = F.count(F.lit(1))
    aggs = [
        F.struct(
            count_if(F.expr(condition)).alias("valid_count"),
            total.alias("total_count"),
            pct(count_if(F.expr(condition)), total).alias("validity_percentage"),
        ).alias(f"_{i}")
        for i, condition in enumerate(rules.values())
    ]
    fields = ["valid_count", "total_count", "validity_percentage"]
    return _unpivot(df.agg(*aggs), list(rules), "rule_name", fields)


def duplicate_report(df: DataFrame, critical: Sequence[str]) -> DataFrame:
    """Total rows, surplus copies, and nulls per critical column, in one shuffle.

    Copies are counted map-side before the shuffle; the null counts are summed
    from the same groups, so the input is read once.
    """
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"),
        *[
            F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"{c}_nulls")
            for c in critical
        ],
    )


def quality_score(
    df: DataFrame,
    required: Sequence[str],
    unique: Sequence[str],
    rules: Mapping[str, str],
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    threshold: float = 0.95,
) -> DataFrame:
    """Weighted mean of completeness, uniqueness and validity in 0..1, with a pass flag."""
    total = F.count(F.lit(1))

    def mean(parts: list[Column]) -> Column:
        return sum(parts[1:], parts[0]) / F.lit(float(len(parts)))

    share = lambda part: F.try_divide(part.cast("double"), F.col("_n").cast("double"))
    flat = df.agg(
        total.alias("_n"),
        *[F.count(c).alias(f"c{i}") for i, c in enumerate(required)],
        *[_null_seen(c).alias(f"z{i}") for i, c in enumerate(unique)],
        *[count_if(F.expr(e)).alias(f"v{i}") for i, e in enumerate(rules.values())],
    )
    flat = flat.crossJoin(distinct_counts(df, unique))  # one row each
    scored = flat.select(
        mean([share(F.col(f"c{i}")) for i in range(len(required))]).alias("completeness"),
        mean([share(F.col(f"u{i}") + F.col(f"z{i}")) for i in range(len(unique))]).alias("uniqueness"),
        mean([share(F.col(f"v{i}")) for i in range(len(rules))]).alias("validity"),
    )
    a, b, c = weights
    score = (a * F.col("completeness") + b * F.col("uniqueness") + c * F.col("validity")) / F.lit(a + b + c)
    return scored.withColumn("score", score).withColumn("passed", F.col("score") >= threshold)


def freshness(df: DataFrame, source: str, ts: str, as_of: str) -> DataFrame:
    """Newest record and its age in seconds per source."""
    newest = df.groupBy(source).agg(F.max(ts).alias("newest"))
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))
    return newest.withColumn("age_seconds", F.floor(age / 1_000_000).cast("long"))


def profile(df: DataFrame, columns: Sequence[str], exact_distinct: bool = False) -> DataFrame:
    """One row per column: count, nulls, distinct, min, max, mean, stddev, in one scan.

    Distinct counts are sketches by default (constant memory per column).
    """
    numeric = {n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")
               or t.startswith("decimal")}
    null = F.lit(None).cast("double")
    flat = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *([] if exact_distinct else [F.approx_count_distinct(c).alias(f"u{i}") for i, c in enumerate(columns)]),
        *[F.min(c).cast("string").alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("string").alias(f"hi{i}") for i, c in enumerate(columns)],
        *[(F.avg(c) if c in numeric else F.max(null)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[(F.stddev_samp(c) if c in numeric else F.max(null)).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    items = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("_n").alias("row_count"),
            (F.col("_n") - F.col(f"n{i}")).alias("null_count"),
            F.col(f"u{i}").alias("distinct_count"),
            F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"),
            F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("stddev"),
        )
        for i, c in enumerate(columns)
    ]
    if exact_distinct:
        flat = flat.crossJoin(distinct_counts(df, columns))  # one row each
    return flat.select(F.inline(F.array(*items)))


def orphan_count(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent. Keys are counted before the join, so the
    join moves one row per key and a hot key costs no more than any other."""
    keys = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = parent.select(F.col(parent_key).alias("_k"))
    return keys.join(known, "_k", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans"))


def integrity_checks(
    df: DataFrame,
    required: Sequence[str],
    accuracy_rule: str,
    key: str,
    parent: DataFrame,
    parent_key: str,
    ts: str,
    as_of: str,
    max_age_days: int,
) -> DataFrame:
    """Completeness, accuracy, consistency, timeliness; ``all_hold`` is their conjunction."""
    oldest_allowed = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {max_age_days} days")
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    flags = df.agg(
        F.coalesce(F.bool_and(complete), F.lit(True)).alias("completeness"),
        F.coalesce(F.bool_and(F.coalesce(F.expr(accuracy_rule), F.lit(False))), F.lit(True)).alias("accuracy"),
        F.coalesce(F.max(ts) >= oldest_allowed, F.lit(False)).alias("timeliness"),
    )
    orphans = orphan_count(df, key, parent, parent_key)
    return flags.withColumn("consistency", orphans.scalar() == 0).withColumn(
        "all_hold", F.col("completeness") & F.col("accuracy") & F.col("consistency") & F.col("timeliness")
    )
