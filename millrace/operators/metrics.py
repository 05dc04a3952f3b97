"""Metric series: statistics, metric math, costs, trends, backlog and scorecards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.common import bin_start, count_if, micros, pct


def statistics(
    df: DataFrame,
    period_seconds: int,
    by: Sequence[str],
    value: str = "value",
    ts: str = "ts",
) -> DataFrame:
    """Sum, average, maximum, minimum and sample count per series and period."""
    return df.groupBy(*by, bin_start(F.col(ts), period_seconds).alias("period")).agg(
        F.sum(value).alias("sum"),
        F.avg(value).alias("average"),
        F.max(value).alias("maximum"),
        F.min(value).alias("minimum"),
        F.count(value).alias("sample_count"),
    )


def metric_math(df: DataFrame, period_seconds: int, part: Column, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``part / all * 100`` per period, from one pass."""
    rate = pct(F.col("part_count"), F.col("total_count"))
    return (
        df.groupBy(*by, bin_start(F.col(ts), period_seconds).alias("period"))
        .agg(count_if(part).alias("part_count"), F.count(F.lit(1)).alias("total_count"))
        .withColumn("rate", rate)
    )


def cost_per_record(df: DataFrame, by: str, cost: str, records: Column) -> DataFrame:
    """Cost per processed record and group, 0 where nothing was processed."""
    return (
        df.groupBy(by)
        .agg(F.sum(cost).alias("cost"), F.coalesce(F.sum(records), F.lit(0)).alias("records"))
        .withColumn("cost_per_record",
                    F.when(F.col("records") > 0, F.col("cost") / F.col("records")).otherwise(F.lit(0.0)))
    )


def batch_outcomes(df: DataFrame, batch: Column, failed: Column) -> DataFrame:
    """Processed, failed and success rate per batch."""
    bad = F.coalesce(failed, F.lit(False))
    return (
        df.groupBy(batch.alias("batch"))
        .agg(count_if(~bad).alias("processed"), count_if(bad).alias("failed"))
        .withColumn("success_rate", pct(F.col("processed"), F.col("processed") + F.col("failed")))
    )


def to_metric_rows(df: DataFrame, namespace: str, dimensions: Sequence[str], metrics: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Turn columns of an aggregated frame into metric rows.

    ``metrics`` maps metric name to (unit, value column). Result columns:
    namespace, metric_name, the dimensions, value, unit.
    """
    items = F.array(*[
        F.struct(F.lit(name).alias("metric_name"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))
        for name, (unit, value) in metrics.items()
    ])
    return df.select(F.lit(namespace).alias("namespace"), *dimensions, F.inline(items))


def trend(df: DataFrame, metric: str, value: str, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Sum per metric over ``[start, end)`` and its signed % change against the
    range of equal length before it. Both sums come from one scan."""
    t, lo, hi = F.col(ts), F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    before = lo - (hi - lo)
    ranged = df.where((t >= before) & (t < hi))
    sums = ranged.groupBy(metric).agg(
        F.sum(F.when(t >= lo, F.col(value))).alias("value"),
        F.sum(F.when(t < lo, F.col(value))).alias("previous"),
    )
    change = F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")) * 100.0
    return sums.withColumn("trend_percent", change)


def cost_projection(df: DataFrame, dimension: str, cost: str, as_of: str, budget: float, ts: str = "ts") -> DataFrame:
    """Month-to-date spend, straight-line end-of-month projection, budget use and flag."""
    now = F.lit(as_of).cast("timestamp_ntz")
    first = F.date_trunc("month", now).cast("timestamp_ntz")
    days = F.dayofmonth(F.last_day(now)).cast("double")
    elapsed = (micros(now) - micros(first)) / F.lit(86_400_000_000.0)
    spent = df.where((F.col(ts) >= first) & (F.col(ts) < now)).groupBy(dimension).agg(F.sum(cost).alias("month_to_date"))
    return (
        spent.withColumn("projected", F.col("month_to_date") / elapsed * days)
        .withColumn("budget_used_percent", F.col("month_to_date") / F.lit(budget) * 100.0)
        .withColumn("over_budget", F.col("projected") > budget)
    )


def cost_by_tags(df: DataFrame, tags: Sequence[str], cost: str) -> DataFrame:
    """Cost for every combination of tags, with ``ALL`` in totals."""
    totals = df.cube(*tags).agg(F.sum(cost).alias("cost"), *[F.grouping(t).alias(f"_g_{t}") for t in tags])
    return totals.select(
        *[F.when(F.col(f"_g_{t}") == 1, F.lit("ALL")).otherwise(F.coalesce(F.col(t), F.lit("untagged"))).alias(t)
          for t in tags],
        "cost",
    )


def queue_backlog(
    messages: DataFrame, acks: DataFrame, message_id: str, queue: str, ts: str, as_of: str,
    max_visible: int, max_age_seconds: int,
) -> DataFrame:
    """Visible messages and age of the oldest per queue, with both alarm flags."""
    # Repeated acknowledgements collapse before the join, on its own partitioning.
    visible = messages.join(acks.select(message_id).distinct(), message_id, "left_anti")
    now = micros(F.lit(as_of).cast("timestamp_ntz"))
    age = F.floor((now - micros(F.min(ts))) / 1_000_000).cast("long")
    return (
        visible.groupBy(queue)
        .agg(F.count(F.lit(1)).alias("visible"), age.alias("oldest_age_seconds"))
        .withColumn("depth_alarm", F.col("visible") > max_visible)
        .withColumn("age_alarm", F.col("oldest_age_seconds") > max_age_seconds)
    )


def offenders(df: DataFrame, key: str, window_seconds: int, limit: int, ts: str = "ts") -> DataFrame:
    """Keys with more than ``limit`` requests in a window (service defaults: 1000
    requests a second, bursts of 2000)."""
    return (
        df.groupBy(key, bin_start(F.col(ts), window_seconds).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > limit)
    )


#: Service targets as (kpi, comparison, target).
KPI_TARGETS = (
    ("data_quality_score", ">", 95.0),
    ("error_rate", "<", 0.1),
    ("batch_latency_seconds", "<", 300.0),
    ("stream_latency_seconds", "<", 30.0),
    ("availability", ">=", 99.9),
)

_COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def compare(left: Column, op: str, right) -> Column:
    return _COMPARE[op](left, right)


def scorecard(df: DataFrame, kpis: Mapping[str, Column], targets=KPI_TARGETS) -> DataFrame:
    """One row per target: measured value, target and whether it is met."""
    measured = df.agg(*[c.cast("double").alias(name) for name, c in kpis.items()])
    items = [
        F.struct(
            F.lit(name).alias("kpi"),
            F.col(name).alias("value"),
            F.lit(op).alias("comparison"),
            F.lit(target).alias("target"),
            F.coalesce(compare(F.col(name), op, target), F.lit(False)).alias("met"),
        )
        for name, op, target in targets if name in kpis
    ]
    return measured.select(F.inline(F.array(*items)))


def weekly_report(df: DataFrame, as_of: str, group: str, sections: Mapping[tuple[str, str], Column], days: int = 7, ts: str = "ts") -> DataFrame:
    """Section metrics per group and over ``ALL`` groups for the days before ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    week = df.where((F.col(ts) >= now - F.expr(f"interval {days} days")) & (F.col(ts) < now))
    names = {key: f"m{i}" for i, key in enumerate(sections)}
    rolled = week.rollup(group).agg(
        F.grouping(group).alias("_g"), *[c.cast("double").alias(names[k]) for k, c in sections.items()]
    )
    items = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(names[(s, m)]).alias("value"))
        for s, m in sections
    ])
    label = F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.coalesce(F.col(group), F.lit("unknown")))
    return rolled.select(label.alias(group), F.inline(items))


def capacity_trend(df: DataFrame, resource: str, value: str, as_of: str, days: int = 30, ts: str = "ts") -> DataFrame:
    """Slope of daily count and daily sum per resource, with a recommendation."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = df.where((F.col(ts) >= now - F.expr(f"interval {days} days")) & (F.col(ts) < now))
    daily = recent.groupBy(resource, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )
    day_no = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("double")
    return (
        daily.groupBy(resource)
        .agg(F.regr_slope(F.col("n").cast("double"), day_no).alias("count_slope"),
             F.regr_slope("total", day_no).alias("sum_slope"))
        .withColumn("recommendation", F.when(F.col("count_slope") > 0, "scale up").otherwise("hold"))
    )


def variant_metrics(df: DataFrame, variant: str, correct: Column, response: str, impact: Column) -> DataFrame:
    """Accuracy, response time and business impact per variant."""
    return df.groupBy(variant).agg(
        pct(count_if(correct), F.count(F.lit(1))).alias("accuracy"),
        F.avg(response).alias("response_time"),
        F.sum(impact).alias("business_impact"),
    )


def canary_decision(df: DataFrame, by: Sequence[str], failed: Column, min_success: float = 95.0, max_error: float = 5.0) -> DataFrame:
    """Healthy when success is at least 95 % and errors stay below 5 %, else roll back."""
    rates = df.groupBy(*by).agg(
        pct(count_if(~failed), F.count(F.lit(1))).alias("success_percent"),
        pct(count_if(failed), F.count(F.lit(1))).alias("error_percent"),
    )
    healthy = (F.col("success_percent") >= min_success) & (F.col("error_percent") < max_error)
    return rates.withColumn("decision", F.when(healthy, "HEALTHY").otherwise("ROLLBACK"))
