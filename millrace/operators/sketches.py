"""Daily profiles that merge: weeks and rolling references are made from stored sketches, not from rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of the distinct-count sketch: a standard error of 1.6 %.
DISTINCT_LOG2 = 12
#: Size of the quantile sketch: a rank error of about 1 %.
QUANTILE_K = 256
QUANTILES = (0.5, 0.9, 0.99)
#: Shares below this count as this much in a stability index.
LEAST_SHARE = 1e-6

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def daily_sketches(df: DataFrame, ts: str, columns: Sequence[str]) -> DataFrame:
    """(day, column_name, rows, nulls, low, high, mean, m2, distinct_sketch, quantile_sketch): the table to keep.

    One scan and one shuffle of a row per task and day. ``m2`` is the sum of squared deviations; the quantile sketch, mean and ``m2``
    are NULL for columns that are no numbers. Rows without a time have the day NULL.
    """
    kinds = dict(df.dtypes)
    number = {c: kinds[c].startswith(NUMERIC) for c in columns}
    none = lambda kind: F.max(F.lit(None).cast(kind))

    def measures(i: int, c: str) -> list[Column]:
        x, text = F.col(c).cast("double"), F.col(c).cast("string")
        known = [
            F.count(c).alias(f"n{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"),
            F.hll_sketch_agg(text, DISTINCT_LOG2).alias(f"d{i}"),
        ]
        if not number[c]:
            return [*known, none("double").alias(f"m{i}"), none("double").alias(f"v{i}"), none("binary").alias(f"q{i}")]
        return [
            *known, F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(c)).alias(f"v{i}"),
            F.kll_sketch_agg_double(x, QUANTILE_K).alias(f"q{i}"),
        ]

    flat = df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), *[m for i, c in enumerate(columns) for m in measures(i, c)])
    each = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"lo{i}").alias("low"),
            F.col(f"hi{i}").alias("high"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("m2"),
            F.col(f"d{i}").alias("distinct_sketch"), F.col(f"q{i}").alias("quantile_sketch"))
        for i, c in enumerate(columns)
    ])
    return flat.select("day", "rows", F.inline(each))


def merged_profile(daily: DataFrame, period: Column, numeric: Sequence[str] = ()) -> DataFrame:
    """Profile per period of days: counts, extremes, mean and deviation exact, distinct count and quantiles from merged sketches.

    ``low`` and ``high`` compare as numbers for the columns in ``numeric``, as text for others.
    """
    n = F.col("rows") - F.col("nulls")
    is_number = F.col("column_name").isin(list(numeric))
    order = lambda c: F.when(is_number, F.col(c).cast("double"))
    merged = daily.withColumn("period", period).groupBy("period", "column_name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.min("low").alias("text_low"), F.max("high").alias("text_high"),
        F.min_by("low", order("low")).alias("number_low"), F.max_by("high", order("high")).alias("number_high"),
        F.sum(n * F.col("mean")).alias("_sum"), F.sum(n * F.col("mean") * F.col("mean")).alias("_square"), F.sum("m2").alias("_within"),
        F.hll_union_agg("distinct_sketch").alias("_distinct"), F.kll_merge_agg_double("quantile_sketch").alias("_quantiles"))
    count = F.col("rows") - F.col("nulls")
    mean = F.try_divide(F.col("_sum"), count)
    spread = F.col("_within") + F.col("_square") - mean * F.col("_sum")
    ranks = [
        F.when(is_number & (count > 0), F.kll_sketch_get_quantile_double("_quantiles", F.lit(float(q)))).alias(f"p{round(100 * q)}")
        for q in QUANTILES
    ]
    return merged.select(
        "period", "column_name", "rows", "nulls", F.hll_sketch_estimate("_distinct").alias("distinct"),
        F.coalesce("number_low", "text_low").alias("low"), F.coalesce("number_high", "text_high").alias("high"),
        mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(spread, count - 1), F.lit(0.0))).alias("stddev"), *ranks)


def daily_histogram(df: DataFrame, ts: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(day, bin, n) of every day with values, all bins; what lies outside the edges counts in the outer bins."""
    width = (high - low) / bins
    place = F.floor((F.col(value).cast("double") - F.lit(low)) / F.lit(width)).cast("int")
    binned = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(
        F.to_date(ts).alias("day"), F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).alias("bin"))
    counts = binned.groupBy("day").agg(*[F.count(F.when(F.col("bin") == b, 1)).alias(f"b{b}") for b in range(bins)])
    return counts.select("day", F.posexplode(F.array(*[f"b{b}" for b in range(bins)])).alias("bin", "n"))


def rolling_drift(histogram: DataFrame, days: int = 7, limit: float = 0.1) -> DataFrame:
    """(day, reference_rows, psi, drift): population stability of each day against the ``days`` days before it.

    Works on the stored histograms (days times bins rows). A day without any earlier one in reach has no index.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("bin").orderBy("_day").rangeBetween(-days, -1)
    known = histogram.withColumn("_day", number).withColumn("_ref", F.coalesce(F.sum("n").over(before), F.lit(0)))
    of_day = Window.partitionBy("day")
    shares = known.withColumns({"_total": F.sum("n").over(of_day), "_refs": F.sum("_ref").over(of_day)})
    least = F.lit(LEAST_SHARE)
    current = F.greatest(F.col("n") / F.col("_total"), least)
    reference = F.greatest(F.try_divide(F.col("_ref"), F.col("_refs")), least)
    psi = F.sum(F.when(F.col("_refs") > 0, (current - reference) * F.ln(current / reference)))
    return shares.groupBy("day").agg(F.max("_refs").alias("reference_rows"), psi.alias("psi")).withColumn(
        "drift", F.coalesce(F.col("psi") > limit, F.lit(False)))
