"""Declarative validation: rules are data and compile to one projection.

Every rule turns into one ``CASE`` inside a single ``array`` column, so a table
is read once however many rules apply to it; only violations are exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.common import count_if

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"

RESULT_TYPE = "struct<severity:string,message:string,property_name:string,suggested_fix:string>"


@dataclass(frozen=True)
class Rule:
    """``violated`` maps a frame to a boolean column; NULL counts as not violated."""

    property_name: str
    violated: Callable[[DataFrame], Column]
    message: str | Callable[[DataFrame], Column]
    severity: str = ERROR
    suggested_fix: str = ""

    def compile(self, df: DataFrame) -> Column:
        try:
            condition = self.violated(df)
            message = F.lit(self.message) if isinstance(self.message, str) else self.message(df)
            severity, fix = self.severity, self.suggested_fix
            # Resolve now, so that a rule naming an absent column fails alone.
            df.select(condition, message).schema
        except Exception as exc:  # a broken rule is a result, not a crash
            condition, severity = F.lit(True), ERROR
            message = F.lit(f"Validator error: {type(exc).__name__}")
            fix = "Check validator implementation"
        return F.when(
            condition,
            F.struct(
                F.lit(severity).alias("severity"),
                message.cast("string").alias("message"),
                F.lit(self.property_name).alias("property_name"),
                F.lit(fix).alias("suggested_fix"),
            ),
        )


def required(column: str, severity: str = ERROR) -> Rule:
    return Rule(column, lambda d: F.col(column).isNull(), "required value is missing", severity,
                f"Provide {column}")


def of_type(column: str, type_name: str, severity: str = ERROR) -> Rule:
    return Rule(
        column,
        lambda d: F.col(column).isNotNull() & F.expr(f"try_cast(`{column}` as {type_name})").isNull(),
        f"value is not a {type_name}", severity, f"Use a {type_name} value",
    )


def min_value(column: str, bound, severity: str = ERROR) -> Rule:
    return Rule(column, lambda d: F.col(column) < bound, f"value is below {bound}", severity,
                f"Use a value of at least {bound}")


def max_value(column: str, bound, severity: str = ERROR) -> Rule:
    return Rule(column, lambda d: F.col(column) > bound, f"value is above {bound}", severity,
                f"Use a value of at most {bound}")


def min_length(column: str, bound: int, severity: str = ERROR) -> Rule:
    return Rule(column, lambda d: F.length(column) < bound, f"shorter than {bound} characters",
                severity, f"Use at least {bound} characters")


def max_length(column: str, bound: int, severity: str = ERROR) -> Rule:
    return Rule(column, lambda d: F.length(column) > bound, f"longer than {bound} characters",
                severity, f"Use at most {bound} characters")


def matches(column: str, pattern: str, severity: str = ERROR) -> Rule:
    return Rule(column, lambda d: ~F.col(column).rlike(pattern), f"does not match {pattern}",
                severity, "Use the documented format")


def allowed(column: str, values: Sequence, severity: str = ERROR) -> Rule:
    return Rule(column, lambda d: ~F.col(column).isin(list(values)), "value is not allowed",
                severity, "Use one of: " + ", ".join(str(v) for v in values))


def custom(name: str, validator: Callable[[DataFrame], Column], message: str, severity: str = ERROR) -> Rule:
    """User rule: ``validator`` returns the column that is true for VALID rows."""
    return Rule(name, lambda d: ~F.coalesce(validator(d), F.lit(False)), message, severity)


def declare(
    property_name: str,
    data_type: str,
    required_value: bool = True,
    low=None,
    high=None,
    shortest: int | None = None,
    longest: int | None = None,
    pattern: str | None = None,
    allowed_values: Sequence | None = None,
    validator: Callable[[DataFrame], Column] | None = None,
    severity: str = ERROR,
) -> list[Rule]:
    """All rules of one declared property. Bounds apply to the value read as ``data_type``."""
    c = property_name
    rules = [required(c, severity)] if required_value else []
    rules.append(of_type(c, data_type, severity))
    typed = lambda: F.expr(f"try_cast(`{c}` as {data_type})")
    if low is not None:
        rules.append(Rule(c, lambda d: typed() < low, f"value is below {low}", severity, f"Use a value of at least {low}"))
    if high is not None:
        rules.append(Rule(c, lambda d: typed() > high, f"value is above {high}", severity, f"Use a value of at most {high}"))
    if shortest is not None:
        rules.append(min_length(c, shortest, severity))
    if longest is not None:
        rules.append(max_length(c, longest, severity))
    if pattern is not None:
        rules.append(matches(c, pattern, severity))
    if allowed_values is not None:
        rules.append(allowed(c, allowed_values, severity))
    if validator is not None:
        rules.append(custom(c, validator, "custom check failed", severity))
    return rules


# --- fixed values: common properties as arguments of ``declare`` ---------------
COMMON_PROPERTIES = {
    "environment": {"data_type": "string", "pattern": "^(dev|staging|prod|sandbox|dr)$"},
    "instance_type": {"data_type": "string", "pattern": r"^[a-z][0-9]+[a-z]*\.[a-z0-9]+$"},
    "port": {"data_type": "int", "low": 1, "high": 65535},
    "retention_days": {"data_type": "int", "low": 1, "high": 3653},
    "memory_size": {"data_type": "int", "low": 128, "high": 10240},
    "timeout_seconds": {"data_type": "int", "low": 1, "high": 900},
}
# -------------------------------------------------------------------------------


def violations(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row per violated rule: keys, severity, message, property_name, suggested_fix."""
    found = F.array_compact(F.array(*[r.compile(df) for r in rules]))
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.*")


def validation_results(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """As :func:`violations`, plus one valid INFO row for rows without any."""
    found = F.array_compact(F.array(*[r.compile(df) for r in rules]))
    clean = F.array(
        F.struct(
            F.lit(INFO).alias("severity"),
            F.lit("valid").alias("message"),
            F.lit(None).cast(T.StringType()).alias("property_name"),
            F.lit(None).cast(T.StringType()).alias("suggested_fix"),
        )
    )
    rows = df.select(*keys, F.explode(F.when(F.size(found) == 0, clean).otherwise(found)).alias("v"))
    return rows.select(*keys, (F.col("v.severity") == INFO).alias("is_valid"), "v.*")


def validation_report(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per severity; overall status holds when every ERROR row is valid."""
    is_error = F.col("severity") == ERROR
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("severity") == INFO).alias("info_count"),
        count_if(F.col("severity") == WARNING).alias("warning_count"),
        count_if(is_error).alias("error_count"),
        F.coalesce(F.bool_and(F.when(is_error, F.col("is_valid"))), F.lit(True)).alias("overall_status"),
    )
