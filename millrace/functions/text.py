"""Text functions: error classification, rule tagging, sensitive-data patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.common import all_of, any_of

# --- fixed values ------------------------------------------------------------
#: First match wins: (terms, error_type, severity, confidence).
ERROR_CLASSES = (
    (("ImportError", "ModuleNotFoundError"), "import_error", "low", 0.9),
    (("KeyError",), "key_error", "medium", 0.8),
    (("AttributeError",), "attribute_error", "medium", 0.8),
    (("TypeError",), "type_error", "medium", 0.7),
    (("ConnectionError", "TimeoutError"), "network_error", "high", 0.9),
)
UNKNOWN_ERROR = ("unknown", "medium", 0.0)

#: Patterns stay in the subset that Java and RE2 read alike.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -][0-9]{4}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}
SECRET_PATTERNS = {
    "assignment": r"(?:api_key|apikey|secret|password|token) *[=:] *[^ \n]+",
    "access_key_id": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
#: Literals without which a pattern cannot match; looking for them is much
#: cheaper than matching.
NEEDED_LITERALS = {"email": "@", "access_key_id": "AKIA", "private_key": "-----BEGIN"}
# -------------------------------------------------------------------------------


def classify_error(message: Column) -> Column:
    """Struct error_type, severity, confidence of an error message."""

    def verdict(kind, severity, confidence):
        return F.struct(
            F.lit(kind).alias("error_type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))

    chosen = None
    for terms, *rest in ERROR_CLASSES:
        test = any_of([message.contains(t) for t in terms])
        chosen = F.when(test, verdict(*rest)) if chosen is None else chosen.when(test, verdict(*rest))
    return chosen.otherwise(verdict(*UNKNOWN_ERROR))


@dataclass(frozen=True)
class TagRule:
    """Tag a text that has all, any and none of the given literals."""

    tag: str
    impact: str
    metric: str
    score: int
    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()

    def test(self, text: Column) -> Column:
        parts = [text.contains(t) for t in self.all]
        if self.any:
            parts.append(any_of([text.contains(t) for t in self.any]))
        parts += [~text.contains(t) for t in self.none]
        return all_of(parts)


# --- fixed values: review hints ------------------------------------------------
CODE_HINTS = (
    TagRule("comprehension", "medium", "performance_gain", 15, all=("for ", "append(")),
    TagRule("string_join", "high", "performance_gain", 25, all=("+=", "str")),
    TagRule("sql_injection", "critical", "security_improvements", 1, all=("execute(", "%")),
    TagRule("input_validation", "high", "security_improvements", 1, all=("input(",)),
    TagRule("error_handling", "medium", "maintainability_score", 10, any=("open(", "requests."), none=("try:",)),
    TagRule("logging", "low", "maintainability_score", 5, all=("print(",)),
)
# -------------------------------------------------------------------------------


def tag_text(text: Column, rules: Sequence[TagRule]) -> Column:
    """Array of struct tag, impact, metric, score for the rules that apply."""
    return F.array_compact(F.array(*[
        F.when(r.test(text), F.struct(
            F.lit(r.tag).alias("tag"), F.lit(r.impact).alias("impact"), F.lit(r.metric).alias("metric"),
            F.lit(r.score).alias("score")))
        for r in rules
    ]))


def pattern_counts(text: Column, patterns: Mapping[str, str]) -> Column:
    """Array of struct kind, n with the matches of every pattern that occurs."""
    def count(kind: str, pattern: str) -> Column:
        matches = F.regexp_count(text, F.lit(pattern))
        if kind not in NEEDED_LITERALS:
            return matches
        return F.when(F.contains(text, F.lit(NEEDED_LITERALS[kind])), matches).otherwise(F.lit(0))

    counts = F.array(*[F.struct(F.lit(k).alias("kind"), count(k, p).alias("n")) for k, p in patterns.items()])
    return F.filter(counts, lambda c: c["n"] > 0)


def mask_patterns(text: Column, patterns: Mapping[str, str]) -> Column:
    """Text with every match replaced by the bracketed kind."""
    for kind, pattern in patterns.items():
        masked = F.regexp_replace(text, pattern, f"[{kind}]")
        if kind in NEEDED_LITERALS:
            masked = F.when(F.contains(text, F.lit(NEEDED_LITERALS[kind])), masked).otherwise(text)
        text = masked
    return text


def tokens(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))
