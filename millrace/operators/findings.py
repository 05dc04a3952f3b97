"""Security findings: severity normalisation, counts, risk, lookups, incident routes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.common import count_if

# --- fixed values ------------------------------------------------------------
#: Tool severities (lower case) that count as high and as medium; the rest is
#: low. ``None`` marks scales of tools that do not rate: all findings are high.
SCALES: Mapping[str, tuple[tuple[str, ...], tuple[str, ...]] | None] = {
    "graded_or_level": (("high", "error"), ("medium", "warning")),
    "critical": (("high", "critical"), ("medium",)),
    "level": (("error",), ("warning",)),
    "unrated": None,
}

PROBLEM_LICENSES = ("GPL", "AGPL", "LGPL")
MEDIUM_ABOVE = 5
LOW_ABOVE = 10
# ------------------------------------------------------------------------------

LEVELS = ("high", "medium", "low")


def normal_severity(severity: Column, scale: str) -> Column:
    """Severity of one scale as high, medium or low."""
    terms = SCALES[scale]
    if terms is None:
        return F.lit("high")
    high, medium = terms
    text = F.lower(F.coalesce(severity, F.lit("")))
    return F.when(text.isin(*high), "high").when(text.isin(*medium), "medium").otherwise("low")


def normalise(df: DataFrame, tool: str, severity: str, tool_scales: Mapping[str, str], default: str = "level") -> DataFrame:
    """Add ``level`` by the scale of each row's tool."""
    level = normal_severity(F.col(severity), default)
    for name, scale in tool_scales.items():
        level = F.when(F.col(tool) == name, normal_severity(F.col(severity), scale)).otherwise(level)
    return df.withColumn("level", level)


def severity_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[count_if(F.col("level") == lv).alias(lv) for lv in LEVELS])


def risk_level(high: Column, medium: Column, low: Column) -> Column:
    return (
        F.when(high > 0, "HIGH").when(medium > MEDIUM_ABOVE, "MEDIUM").when(low > LOW_ABOVE, "LOW")
        .otherwise("MINIMAL")
    )


def risk_summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over tools and the risk they amount to."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        counts.groupBy(*by)
        .agg(
            total(F.col("high") + F.col("medium") + F.col("low")).alias("total_issues"),
            total("high").alias("high_severity"),
            total("medium").alias("medium_severity"),
            total("low").alias("low_severity"),
        )
        .withColumn("risk_level", risk_level(F.col("high_severity"), F.col("medium_severity"), F.col("low_severity")))
    )


def union_findings(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All findings in one frame with their ``source``; absent columns become NULL."""
    result = None
    for name, frame in sources.items():
        tagged = frame.withColumn("source", F.lit(name))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    return result


def license_matches(df: DataFrame, text: str, terms: Sequence[str] = PROBLEM_LICENSES) -> DataFrame:
    """One row per (row, term) whose upper-cased text contains the term."""
    upper = F.upper(text)
    hits = F.array_compact(F.array(*[F.when(F.contains(upper, F.lit(t)), F.lit(t)) for t in terms]))
    return df.withColumn("license_term", F.explode(hits))


def route_incident(severity: Column) -> Column:
    return F.when(severity == "HIGH", "ImmediateResponse").when(severity == "MEDIUM", "StandardResponse").otherwise(
        "LogIncident")


def missing_required(df: DataFrame, present: Column, required: Sequence[str], out: str = "missing") -> DataFrame:
    """One row per required item absent from the row's ``present`` array."""
    wanted = F.array(*[F.lit(r) for r in required])
    absent = F.array_except(wanted, F.coalesce(present, F.array().cast("array<string>")))
    return df.withColumn(out, F.explode(absent))


def except_required(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required rows that are not present. Both sides are reduced to distinct rows
    first, so copies of a present row never reach the comparison."""
    return required.distinct().subtract(present.distinct())
