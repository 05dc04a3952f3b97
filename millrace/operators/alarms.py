"""Alarm evaluation over period statistics."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import bin_start, from_micros, micros
from millrace.operators.metrics import compare

NOT_BREACHING, BREACHING = "NOT_BREACHING", "BREACHING"
OUTSIDE_BAND = "outside"

#: Periods made from one row at a time, so that a stray early time makes no giant array.
GRID_BLOCK = 1_024

# --- fixed values: default alarm limits per metric -----------------------------
METRIC_THRESHOLDS = {"Errors": 5, "Duration": 30000, "Throttles": 1, "CPUUtilization": 80, "MemoryUtilization": 80}
OTHER_THRESHOLD = 100
# --------------------------------------------------------------------------------


def dense_periods(stats: DataFrame, series: Sequence[str], period: str, period_seconds: int) -> DataFrame:
    """Every period of every series between its first and last one.

    Works on period statistics, so its size is series times periods, whatever
    the number of samples.
    """
    step = period_seconds * 1_000_000
    spans = stats.groupBy(*series).agg(micros(F.min(period)).alias("lo"), micros(F.max(period)).alias("hi"))
    block = F.lit(step * GRID_BLOCK).cast("long")
    blocks = spans.select(*series, "hi", F.explode(F.sequence("lo", "hi", block)).alias("_at"))
    upto = F.least("hi", F.col("_at") + block - step)
    starts = blocks.select(*series, F.explode(F.sequence("_at", upto, F.lit(step).cast("long"))).alias("_us"))
    grid = starts.select(*series, from_micros(F.col("_us")).alias(period))
    return grid.join(stats, [*series, period], "left")


def breach(value: Column, op: str, threshold) -> Column:
    """Breach test; ``op='outside'`` takes a (lower, upper) threshold."""
    if op == OUTSIDE_BAND:
        lower, upper = threshold
        return (value < lower) | (value > upper)
    return compare(value, op, threshold)


def evaluate(
    stats: DataFrame,
    series: Sequence[str],
    value: str,
    threshold,
    op: str = ">=",
    evaluation_periods: int = 2,
    missing: str = NOT_BREACHING,
    period: str = "period",
    period_seconds: int = 300,
) -> DataFrame:
    """State per series and period: ALARM after n consecutive breaching periods."""
    grid = dense_periods(stats, series, period, period_seconds)
    bad = F.coalesce(breach(F.col(value), op, threshold), F.lit(missing == BREACHING))
    run = Window.partitionBy(*series).orderBy(period).rowsBetween(1 - evaluation_periods, 0)
    enough = F.count(F.lit(1)).over(run) == evaluation_periods
    return grid.withColumn("_bad", bad).withColumn(
        "state", F.when(enough & F.min("_bad").over(run), "ALARM").otherwise("OK")
    ).drop("_bad")


def evaluate_all(
    stats: DataFrame,
    series: Sequence[str],
    specs: Mapping[str, tuple[str, str, object, int, str]],
    period: str = "period",
    period_seconds: int = 300,
) -> DataFrame:
    """(series, period, alarm, state) of several alarms over one statistics frame.

    ``specs``: alarm name to (value column, operator, threshold, periods, missing).
    The grid and its window are made once for all of them.
    """
    grid = dense_periods(stats, series, period, period_seconds)
    ordered = Window.partitionBy(*series).orderBy(period)
    names = {name: f"_bad{i}" for i, name in enumerate(specs)}
    flagged = grid.withColumns({
        names[name]: F.coalesce(breach(F.col(value), op, threshold), F.lit(missing == BREACHING))
        for name, (value, op, threshold, _, missing) in specs.items()
    })

    def state(name: str, periods: int) -> Column:
        run = ordered.rowsBetween(1 - periods, 0)
        enough = F.count(F.lit(1)).over(run) == periods
        return F.when(enough & F.min(names[name]).over(run), "ALARM").otherwise("OK")

    judged = flagged.select(*series, period, *[state(n, spec[3]).alias(names[n]) for n, spec in specs.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("alarm"), F.col(names[n]).alias("state")) for n in specs])
    return judged.select(*series, period, F.inline(rows))


def with_default_limits(stats: DataFrame, metric: str) -> DataFrame:
    """Add ``threshold`` and ``op``: known metrics alarm above theirs, others below the common one."""
    limits = F.create_map(*[F.lit(x) for name, limit in METRIC_THRESHOLDS.items() for x in (name, float(limit))])
    found = F.try_element_at(limits, F.col(metric))
    return stats.withColumns({
        "threshold": F.coalesce(found, F.lit(float(OTHER_THRESHOLD))),
        "op": F.when(found.isNotNull(), ">").otherwise("<"),
    })


def default_states(stats: DataFrame, series: Sequence[str], metric: str, value: str, evaluation_periods: int = 2,
                   period: str = "period", period_seconds: int = 300) -> DataFrame:
    """State of every metric series against its default limit: n breaching periods in a row, gaps not breaching.

    Every period from a series' first to its last has a row; ``metric`` must be one of ``series``.
    """
    limited = with_default_limits(dense_periods(stats, series, period, period_seconds), metric)
    bad = F.when(F.col("op") == ">", F.col(value) > F.col("threshold")).otherwise(F.col(value) < F.col("threshold"))
    run = Window.partitionBy(*series).orderBy(period).rowsBetween(1 - evaluation_periods, 0)
    enough = F.count(F.lit(1)).over(run) == evaluation_periods
    return limited.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn(
        "state", F.when(enough & F.min("_bad").over(run), "ALARM").otherwise("OK")
    ).drop("_bad")


def anomaly_band(
    stats: DataFrame,
    series: Sequence[str],
    value: str,
    history: int = 12,
    factor: float = 2.0,
    min_history: int = 3,
    evaluation_periods: int = 2,
    period: str = "period",
    period_seconds: int = 3600,
) -> DataFrame:
    """Compare each period with mean +- ``factor`` deviations of the ``history`` periods before it.

    Every period from a series' first to its last has a row; those without a value are not anomalous and add nothing to the history.
    """
    stats = dense_periods(stats, series, period, period_seconds)
    ordered = Window.partitionBy(*series).orderBy(period)
    past = ordered.rowsBetween(-history, -1)
    banded = stats.withColumns({
        "_n": F.count(value).over(past),
        "expected": F.avg(value).over(past),
        "_dev": F.stddev_pop(value).over(past),
    })
    out = F.abs(F.col(value) - F.col("expected")) > F.lit(factor) * F.col("_dev")
    flagged = banded.withColumn("anomalous", (F.col("_n") >= min_history) & F.coalesce(out, F.lit(False)))
    run = ordered.rowsBetween(1 - evaluation_periods, 0)
    state = F.when((F.count(F.lit(1)).over(run) == evaluation_periods) & F.min("anomalous").over(run), "ALARM")
    return flagged.withColumn("state", state.otherwise("OK")).drop("_n", "_dev")


_ALARM_CALL = re.compile(r"\b(ALARM|OK)\(\s*['\"]?([A-Za-z0-9_-]+)['\"]?\s*\)")


def composite(states: DataFrame, alarm: str, rule: str, by: Sequence[str] = ("period",), state: str = "state") -> DataFrame:
    """State of a boolean rule such as ``ALARM('a') OR ALARM('b')`` per period.

    Alarms without a row in a period count as not in the asked state.
    """
    names = list(dict.fromkeys(m.group(2) for m in _ALARM_CALL.finditer(rule)))
    wide = states.where(F.col(alarm).isin(names)).groupBy(*by).agg(
        *[F.max(F.when(F.col(alarm) == n, F.col(state))).alias(n) for n in names]
    )
    condition = _ALARM_CALL.sub(lambda m: f"coalesce(`{m.group(2)}` = '{m.group(1)}', false)", rule)
    return wide.withColumn("composite", F.when(F.expr(condition), "ALARM").otherwise("OK"))


def period_statistics(df: DataFrame, series: Sequence[str], aggregates: Mapping[str, Column], period_seconds: int = 300, ts: str = "ts") -> DataFrame:
    """Samples reduced to one row per series and period."""
    return df.groupBy(*series, bin_start(F.col(ts), period_seconds).alias("period")).agg(
        *[c.alias(n) for n, c in aggregates.items()]
    )
